"""Repair of conversation structure at the least cost, by dynamic programming over a shared grammar.

A repaired conversation has the role initials ``(s?(ua)+)?``.  Rows that are
blank or say again what the same role said before must go; every other row may
stay, change to the role user or assistant, or go; empty user and assistant
rows may be put in anywhere.  Among the cheapest repairs the one whose audit
(a letter per edit: Delete, Insert, Keep, Rerole) is least in ASCII order
holds; an audit fixes the repair.

Method.  Each row is a symbol (initial of the role, fault).  Symbol sequences
are compressed by Re-Pair: rounds of pair counts over all distinct sequences,
each making rules of its most frequent pairs.  For a symbol or rule a min-plus
transfer matrix holds, for any two of the four states (start, after system,
after user, after assistant), the least cost and a rope with the least audit
between them.  Matrices of rules are worked out bottom-up from those of their
halves, once per task, and shared by all conversations; a sequence is the
product of the matrices of its compressed symbols.

Scale.  Rows are numbered in the total order (conversation, turn, role, text)
by a range partitioning, and conversations are cut into blocks of at most
``BLOCK`` rows there, so that no conversation has to fit into a task, however
many rows it has.  Matrices are made per block; a running pass over the blocks
in order, which keeps four states and four small back pointers a block, picks
one entry of each.  Rows take their edits by position, a join without hot keys.

Defined cases: rows are taken by turn, nulls first, equal turns by role and
text; null roles and texts are one space, null conversation ids are one
conversation; roles that begin with another letter than s, u or a can only be
re-roled or deleted; columns other than the four are ignored; an empty table
gives empty tables.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flockwatch.llm.common import SPACES, slices
from flockwatch.operators.ranking import global_positions
from flockwatch.session import materialize

BLOCK = 4096
# Bounds of the grammar: fewer rules compress less and change no result.
MAX_RULES, MAX_ROUNDS, RULES_A_ROUND = 192, 8, 48

# Symbols: must be deleted; system, user, assistant, other; the same with a truncated text.
SYMBOLS = "xsuaoSUAO"
FIRST_RULE = 0x4E00
START, SYSTEM, USER, ASSISTANT = range(4)
# Letters of the inner audit: I and J insert user and assistant, R and S change to them.  Two letters
# of one kind never compete at one place, so their order is that of the audit.
INSERTS = {START: [(START, 0, ""), (USER, 2, "I"), (ASSISTANT, 4, "IJ")],
           SYSTEM: [(SYSTEM, 0, ""), (USER, 2, "I"), (ASSISTANT, 4, "IJ")],
           USER: [(USER, 0, ""), (ASSISTANT, 2, "J")],
           ASSISTANT: [(ASSISTANT, 0, ""), (USER, 2, "I")]}
CLOSINGS = {START: (0, ""), SYSTEM: (4, "IJ"), USER: (2, "J"), ASSISTANT: (0, "")}


# Faults ---------------------------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) damaged by crc32(``conv_id:turn``) mod 20, nulls there being one space.

    0 drops the row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes it the user's.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return (conversations.withColumn("_kind", kind).where("_kind <> 0")
            .select("conv_id", "turn",
                    F.when(F.col("_kind") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
                    F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(text, ".!?", ""))
                    .otherwise(text).alias("text"),
                    F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
                    .alias("_copy"))
            .drop("_copy"))


def _ordered_rows(conversations: DataFrame) -> DataFrame:
    """The rows with ``pos`` (place in the total order), ``fault`` and ``sym``; written once."""
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    # The last sort key parts equal rows, so that any number of them spreads over the ranges.
    rows = global_positions(rows.withColumn("_copy", F.monotonically_increasing_id()),
                            ["conv_id", "turn", "role", "text", "_copy"], "pos")
    rows = rows.withColumn("_last", F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1)))
    said = (rows.where("_last <> ''").groupBy("conv_id", "role", F.sha2("text", 256).alias("_said"))
            .agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("_first")))
    fault = (F.when(F.col("_last") == "", "blank").when(F.col("_first").isNull(), "duplicate")
             .when(~F.col("_last").isin(".", "!", "?"), "truncated"))
    initial = F.substring("role", 1, 1)
    return (rows.join(said, "pos", "left").withColumn("fault", fault)
            .withColumn("ini", F.when(initial.isin("s", "u", "a"), initial).otherwise("o"))
            .withColumn("sym", F.when(F.col("fault").isin("blank", "duplicate"), "x")
                        .when(F.col("fault") == "truncated", F.upper("ini")).otherwise(F.col("ini")))
            .select("conv_id", "turn", "role", "text", "pos", "fault", "ini", "sym"))


def _blocks(rows: DataFrame) -> DataFrame:
    """A row per conversation and block of positions, with its symbols and counts."""
    n = lambda kind: F.count(F.when(F.col("fault") == kind, 1)).alias(kind)
    one = (rows.groupBy("conv_id", F.expr(f"pos div {BLOCK}").alias("block"))
           .agg(F.array_sort(F.collect_list(F.struct("pos", "sym", "ini", "turn"))).alias("r"),
                n("blank"), n("duplicate"), n("truncated"), F.min("turn").alias("low"), F.max("turn").alias("high"),
                F.size(F.collect_set("turn")).alias("turns")))
    joined = lambda field: F.array_join(F.transform("r", lambda x: x[field]), "")
    pairs = sum((F.length("inis") - F.length(F.replace("inis", F.lit(p), F.lit("")))) / 2 for p in ("su", "ua", "au"))
    return (one.withColumn("inis", joined("ini"))
            .select("conv_id", F.col("r")[0]["pos"].alias("first"), joined("sym").alias("seq"),
                    F.substring("inis", 1, 1).alias("ini_first"), F.expr("right(inis, 1)").alias("ini_last"),
                    F.col("r")[0]["turn"].alias("turn_first"), F.element_at("r", -1)["turn"].alias("turn_last"),
                    (F.length("inis") - 1 - pairs.cast("long")).cast("long").alias("illegal"),
                    "blank", "duplicate", "truncated", "low", "high", F.col("turns").cast("long").alias("turns")))


# Grammar --------------------------------------------------------------------

def compress(seq: str, rules: list[str]) -> str:
    """``seq`` with every rule applied in order; rule k stands as character FIRST_RULE + k."""
    for k, pair in enumerate(rules):
        if len(seq) < 2:
            break
        seq = seq.replace(pair, chr(FIRST_RULE + k))
    return seq


def _count_pairs(seq: str, weight: int, counts: Counter) -> None:
    skip = False
    for a, b in zip(seq, seq[1:], strict=False):
        if a == b and skip:         # of a run, every other pair: they do not overlap
            skip = False
            continue
        counts[a + b] += weight
        skip = a == b


def learn_rules(sequences: DataFrame) -> list[str]:
    """Re-Pair rules for (seq, n), from counts over all sequences.

    A round counts the pairs of the compressed sequences and makes rules of
    the most frequent ones that share no symbol with each other.  The counts
    that come to the driver are bounded by the square of the alphabet.
    """
    rules: list[str] = []
    for _ in range(MAX_ROUNDS):
        def count(batches: Iterator[pa.RecordBatch], known=tuple(rules)) -> Iterator[pa.RecordBatch]:
            counts: Counter = Counter()
            for batch in batches:
                for seq, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    _count_pairs(compress(seq, known), n, counts)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                             names=["pair", "n"])

        found = (sequences.mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
                 .where("n > 1").collect())
        used: set[str] = set()
        fresh = []
        for row in sorted(found, key=lambda r: (-r["n"], r["pair"])):
            if used.isdisjoint(row["pair"]) and len(fresh) < RULES_A_ROUND and len(rules) + len(fresh) < MAX_RULES:
                fresh.append(row["pair"])
                used.update(row["pair"])
        if not fresh:
            break
        rules += fresh
    return rules


class Rope:
    """A string as a pair of ropes: rules share the ropes of their halves."""

    __slots__ = ("left", "right")

    def __init__(self, left, right):
        self.left, self.right = left, right


def _leaves(rope) -> Iterator[str]:
    todo = [rope]
    while todo:
        at = todo.pop()
        while isinstance(at, Rope):
            todo.append(at.right)
            at = at.left
        yield at


def flat(rope) -> str:
    return "".join(_leaves(rope))


def rope_less(a, b) -> bool:
    """a < b as strings, comparing leaf by leaf up to the first difference."""
    if a is b:
        return False
    x, y, xs, ys = "", "", _leaves(a), _leaves(b)
    while True:
        while not x:
            x = next(xs, None)
            if x is None:
                return bool(y) or any(ys)
        while not y:
            y = next(ys, None)
            if y is None:
                return False
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return x[:n] < y[:n]
        x, y = x[n:], y[n:]


Matrix = list[list[tuple | None]]


def symbol_matrix(sym: str) -> Matrix:
    """(cost, audit) from state to state over one row, with the inserts before it."""
    role, cut = sym.lower(), int(sym.isupper())
    m: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for q, paid, ins in INSERTS[i]:
            steps = [(q, 3, "D")]
            if sym != "x":
                goal, letter = (ASSISTANT, "S") if q == USER else (USER, "R")
                steps.append((goal, 2 + cut, letter))
                if (role == "s" and q == START) or (role == "u" and q != USER) or (role == "a" and q == USER):
                    steps.append((SYSTEM if role == "s" else goal, cut, "K"))
            for j, cost, letter in steps:
                entry = (paid + cost, ins + letter)
                if m[i][j] is None or entry < m[i][j]:
                    m[i][j] = entry
    return m


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product; equal costs go to the lesser audit."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for k in range(4):
            if (left := a[i][k]) is None:
                continue
            for j in range(4):
                if (right := b[k][j]) is None:
                    continue
                cost, old = left[0] + right[0], out[i][j]
                if old is None or cost < old[0]:
                    out[i][j] = (cost, Rope(left[1], right[1]))
                elif cost == old[0]:
                    rope = Rope(left[1], right[1])
                    if rope_less(rope, old[1]):
                        out[i][j] = (cost, rope)
    return out


class Grammar:
    """The matrices of all symbols and rules, made bottom-up."""

    def __init__(self, rules: list[str]):
        self.rules = rules
        self.matrix = {s: symbol_matrix(s) for s in SYMBOLS}
        for k, (a, b) in enumerate(rules):
            self.matrix[chr(FIRST_RULE + k)] = product(self.matrix[a], self.matrix[b])

    def evaluate(self, seq: str) -> Matrix:
        symbols = compress(seq, self.rules)
        out = self.matrix[symbols[0]]
        for s in symbols[1:]:
            out = product(out, self.matrix[s])
        return out


def _with_matrices(blocks: DataFrame, rules: list[str]) -> DataFrame:
    """``blocks`` with ``costs`` and ``audits``, 16 entries in row order, null where no repair leads."""
    names = [*blocks.columns, "costs", "audits"]
    at = names.index("seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(rules)

        @lru_cache(maxsize=1000)
        def entries(seq):
            found = [e for row in grammar.evaluate(seq) for e in row]
            return [e and e[0] for e in found], [e and flat(e[1]) for e in found]

        for batch in batches:
            for part in slices(batch, at, 1 << 20):
                costs, audits = zip(*map(entries, part.column(at).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(costs, pa.list_(pa.int64())),
                                                  pa.array(audits, pa.list_(pa.string()))],
                                                 names=names)

    schema = T.StructType([*blocks.schema, T.StructField("costs", T.ArrayType(T.LongType())),
                           T.StructField("audits", T.ArrayType(T.StringType()))])
    return blocks.mapInArrow(run, schema)


def _pick_entries(blocks: DataFrame) -> DataFrame:
    """Per block the entry on the conversation's cheapest path: (first, pick, tail, cost, edge, shared).

    Blocks stream by in order.  Kept per conversation: four costs, their
    paths' order as strings, and a back pointer per state and block.  ``cost``
    stands at the last block, ``edge`` counts an illegal pair of roles and
    ``shared`` a turn that goes on from the block before.
    """
    cols = ["conv_id", "first", "costs", "audits", "ini_first", "ini_last", "turn_first", "turn_last"]

    def ended(steps, state):
        i, (_, rank) = min(((j, (s[0] + CLOSINGS[j][0], s[1])) for j, s in state.items()), key=lambda x: x[1])
        cost, tail = state[i][0] + CLOSINGS[i][0], CLOSINGS[i][1]
        for first, back, edge, shared in reversed(steps):
            before = back[i]
            yield first, 4 * before + i, tail, cost, edge, shared
            i, tail, cost = before, "", None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, steps, state, role, turn = None, [], {}, None, None
        for batch in batches:
            out = []
            for c, first, costs, audits, ini_a, ini_z, turn_a, turn_z in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not steps or c != conv:
                    if steps:
                        out += ended(steps, state)
                    conv, steps, state, edge, shared = c, [], {START: (0, 0)}, 0, 0
                else:
                    edge = int(role + ini_a not in ("su", "ua", "au"))
                    shared = int(turn_a is not None and turn_a == turn)
                role, turn = ini_z, turn_z
                paths = {}
                for j in range(4):
                    ways = [(s[0] + costs[4 * i + j], s[1], audits[4 * i + j], i)
                            for i, s in state.items() if costs[4 * i + j] is not None]
                    if ways:
                        paths[j] = min(ways)
                order = sorted(paths, key=lambda j: paths[j][1:3])
                state = {j: (paths[j][0], order.index(j)) for j in paths}
                steps.append((first, {j: p[3] for j, p in paths.items()}, edge, shared))
            yield batch_of(out)
        if steps:
            yield batch_of(list(ended(steps, state)))

    names = ["first", "pick", "tail", "cost", "edge", "shared"]
    types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def batch_of(rows):
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return (blocks.select(*cols).repartition("conv_id").sortWithinPartitions("conv_id", "first")
            .mapInArrow(run, "first long, pick int, tail string, cost long, edge long, shared long"))


# Repair ---------------------------------------------------------------------

@dataclass
class Repair:
    summary: DataFrame      # a row per conversation: counts, cost, audit
    rows: DataFrame         # the repaired conversations: (conv_id, pos, k, role, text, edit), in order of pos and k


def repair(conversations: DataFrame) -> Repair:
    """The cheapest repair of every conversation of (conv_id, turn, role, text)."""
    rows = materialize(_ordered_rows(conversations), "turns")
    blocks = _blocks(rows)
    blocks = materialize(blocks, "turn-blocks")
    rules = learn_rules(materialize(blocks.groupBy("seq").agg(F.count(F.lit(1)).alias("n")), "role-sequences"))
    blocks = materialize(_with_matrices(blocks, rules), "turn-matrices")
    picked = blocks.join(_pick_entries(blocks), "first")
    picked = picked.withColumn("piece", F.concat(F.col("audits")[F.col("pick")], "tail")).drop("costs", "audits", "seq")
    picked = materialize(picked, "turn-edits")

    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "piece"))), lambda x: x["piece"]), "")
    summary = (picked.groupBy("conv_id")
               .agg(F.coalesce(F.max("high") - F.min("low") + 1 - F.sum(F.col("turns") - F.col("shared")), F.lit(0)).alias("gaps"),
                    *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
                    F.sum(F.col("illegal") + F.col("edge")).alias("illegal"), F.max("cost").alias("cost"),
                    F.translate(audit, "JS", "IR").alias("audit")))

    edits = picked.select("first", F.posexplode(F.expr("regexp_extract_all(piece, '[IJ]*[DKRS](?:[IJ]+$)?', 0)")).alias("_at", "edit"))
    edits = edits.select((F.col("first") + F.col("_at")).alias("pos"), "edit")
    kept = F.regexp_extract("edit", "[DKRS]", 0)
    return Repair(summary, rows.join(edits, "pos").select("conv_id", "pos", F.posexplode(_lines(kept)).alias("k", "_l"))
                  .select("conv_id", "pos", "k", "_l.role", "_l.text", "_l.edit"))


def _lines(kept: Column) -> Column:
    """The rows that a row turns into: those put in before it, itself, those put in at the end."""
    def line(role, text, edit):
        return F.struct(role.alias("role"), text.alias("text"), F.lit(edit).alias("edit"))

    def put_in(letters):
        return F.transform(F.filter(F.split(letters, ""), lambda c: c != ""),
                           lambda c: line(F.when(c == "I", "user").otherwise("assistant"), F.lit(""), "insert"))

    before = F.regexp_extract("edit", "^([IJ]*)", 1)
    after = F.regexp_extract("edit", "[DKRS]([IJ]*)$", 1)
    itself = (F.when(kept == "K", F.array(line(F.col("role"), F.col("text"), "keep")))
              .when(kept == "R", F.array(line(F.lit("user"), F.col("text"), "rerole")))
              .when(kept == "S", F.array(line(F.lit("assistant"), F.col("text"), "rerole")))
              .otherwise(F.array().cast("array<struct<role:string,text:string,edit:string>>")))
    return F.concat(put_in(before), itself, put_in(after))


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the ``role:text`` lines, newline-joined.

    A hash over a whole conversation runs in order, so its rows stream through
    one task; no more than a batch of them is held.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, h = None, None
        for batch in batches:
            ids, sums = [], []
            for c, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if h is None or c != conv:
                    if h is not None:
                        ids.append(conv)
                        sums.append(h.hexdigest())
                    conv, h = c, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema[0].type), pa.array(sums, pa.string())],
                                             names=["conv_id", "repaired_sha256"])
            kind = batch.schema[0].type
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([h.hexdigest()], pa.string())],
                                             names=["conv_id", "repaired_sha256"])

    schema = T.StructType([repaired.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    return (repaired.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "k")
            .select("conv_id", "role", "text").mapInArrow(run, schema))
