"""Edit-aware token counts.

A byte-pair tokenizer first splits a text into pre-tokens and then encodes each
of them alone, so a text's token count is a sum over its pre-tokens.  A
document keeps a segment tree of them: leaves hold up to ``LEAF`` pre-tokens,
inner nodes the sums of characters and tokens below.  An edit finds its place
by descending on characters, splits anew only from two pre-tokens before it
(the pattern looks that far ahead) until a new boundary meets an old one
behind it, and updates the sums above the leaves it touched.

``tree_table`` writes the trees as a table, one row per document with its
leaves; ``update_trees`` applies a table of edits to them and returns the new
table.  Only documents with edits are loaded, their leaves come back with the
stored sums, and only the edited regions are encoded.  ``recount`` builds,
edits and counts in one pass, without storing the trees.

The tokenizer file is read on the driver and broadcast: a rank file has some
50,000 entries, and ``MAX_RANKS`` bounds it.  Counts of pre-tokens are cached
per task in a table of bounded size.

Defined cases: null and empty texts have no tokens; a very long word is one pre-token and is
encoded whole; edits are (start, end,
replacement) in characters, in order and disjoint; a document without edits
keeps its count; repeated rows are counted alike.  In an edit table a null
replacement removes, edits whose id is null or in no document change nothing,
several rows of one id are all edited, and edits that overlap, reach beyond
the text or have a null place fail the job.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAF = 64
MAX_RANKS = 1_000_000
CACHE = 500_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pattern that splits texts before the merges of the rank file.  Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Redactions of the registered query: mail addresses and long numbers.
# Whether a mail address can end a run of its characters does not depend on where in the run it
# begins, so one is tried at the start of a run and behind the last edit only: linear on any text.
_MAIL = r"(?P<mail>[\w.+-]+@[\w-]+\.[\w.-]*\w)"
_MAIL_HERE = re.compile(_MAIL)
_REDACT = re.compile(r"(?<![\w.+-])" + _MAIL + r"|(?P<number>\d(?:[ -]?\d){6,})")


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits that replace mail addresses and numbers of seven digits and more by a mark."""
    edits, at = [], 0
    while m := _MAIL_HERE.match(text, at) or _REDACT.search(text, at):
        edits.append((m.start(), m.end(), f"<{m.lastgroup}>"))
        at = m.end()
    return edits


def load_ranks(path: str = TOKENIZER) -> dict[bytes, int]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    if len(ranks) > MAX_RANKS:
        raise ValueError(f"{path} has more than {MAX_RANKS} ranks")
    return ranks


class PieceCounter(dict):
    """Pre-token to number of tokens; emptied when it holds too many."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex
        import tiktoken
        self.split = regex.compile(PATTERN)
        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> int:
        if len(self) > CACHE:
            self.clear()
        n = self[piece] = len(self.encode(piece))
        return n


class TokenTree:
    """Pre-tokens of one text under sums of characters and tokens."""

    def __init__(self, text: str, counter: PieceCounter):
        pieces = counter.split.findall(text)
        leaves = [pieces[i:i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self._build(leaves, [sum(map(counter.__getitem__, leaf)) for leaf in leaves], counter)

    @classmethod
    def stored(cls, leaves: list[dict], counter: PieceCounter) -> TokenTree:
        """The tree of leaves as ``packed`` gives them; nothing is encoded."""
        tree = cls.__new__(cls)
        cut = [[leaf["text"][a:b] for a, b in zip([0, *leaf["ends"]], leaf["ends"])] for leaf in leaves]
        tree._build(cut or [[]], [leaf["tokens"] for leaf in leaves] or [0], counter)
        return tree

    def packed(self) -> list[dict]:
        """The leaves as text, ends of the pre-tokens and tokens; empty ones go, those grown beyond 2 ``LEAF`` are cut."""
        out = []
        for i, leaf in enumerate(self.leaves):
            whole = len(leaf) <= 2 * LEAF
            for part in [leaf] if whole else [leaf[k:k + LEAF] for k in range(0, len(leaf), LEAF)]:
                if part:
                    tokens = self.tokens[self.size + i] if whole else sum(map(self.counter.__getitem__, part))
                    out.append({"text": "".join(part), "ends": list(accumulate(map(len, part))), "tokens": tokens})
        return out

    def _build(self, leaves: list[list[str]], tokens: list[int], counter: PieceCounter) -> None:
        self.counter, self.leaves = counter, leaves
        size = 1
        while size < len(self.leaves):
            size *= 2
        self.size = size
        self.chars, self.tokens = [0] * (2 * size), [0] * (2 * size)
        for i, leaf in enumerate(self.leaves):
            self.chars[size + i] = sum(map(len, leaf))
            self.tokens[size + i] = tokens[i]
        for i in range(size - 1, 0, -1):
            self._sum(i)
        self.encoded = 0        # pre-tokens counted by edits

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join("".join(leaf) for leaf in self.leaves)

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds character ``place``, and where that leaf begins."""
        i, begin = 1, 0
        while i < self.size:
            i *= 2
            if begin + self.chars[i] <= place:
                begin += self.chars[i]
                i += 1
        return min(i - self.size, len(self.leaves) - 1), begin

    def _update(self, leaf: int) -> None:
        i = self.size + leaf
        self.chars[i] = sum(map(len, self.leaves[leaf]))
        self.tokens[i] = sum(map(self.counter.__getitem__, self.leaves[leaf]))
        while i > 1:
            i //= 2
            self._sum(i)

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace the characters start..end."""
        # First leaf: the one before the edit's, so that two pre-tokens of context are at hand.
        first, begin = self._leaf_at(max(start - 1, 0))
        last = first + 1                                # the leaves first..last-1 are in hand
        pieces = list(self.leaves[first])
        at, k = begin, 0
        while k < len(pieces) and at + len(pieces[k]) < start:
            at += len(pieces[k])
            k += 1
        need = 2 - k
        while need > 0 and first > 0:
            first -= 1
            earlier = self.leaves[first]
            begin -= self.chars[self.size + first]
            pieces = earlier + pieces
            k += len(earlier)
            need -= len(earlier)
        k = max(k - 2, 0)
        head, tail = pieces[:k], pieces[k:]
        begin += sum(map(len, head))
        while last < len(self.leaves) and begin + sum(map(len, tail)) < end:
            tail = tail + self.leaves[last]
            last += 1
        shift = len(replacement) - (end - start)
        behind = start - begin + len(replacement)       # end of the replacement in the new region
        while True:
            old = "".join(tail)
            new = old[:start - begin] + replacement + old[end - begin:]
            whole = last >= len(self.leaves)
            bounds, at = set(), 0
            for p in tail:
                bounds.add(at + shift)
                at += len(p)
            bounds.add(at + shift)
            fresh, at, met = [], 0, None
            for m in self.counter.split.finditer(new):
                if at >= behind and at in bounds:
                    met = at
                    break
                if not whole and m.end() >= len(new) - 2:
                    break                               # the next leaf may change this one
                fresh.append(m.group())
                at = m.end()
            if met is None and whole and at == len(new):
                met = at
            if met is not None:
                break
            for _ in range(max(1, last - first)):       # ever larger steps, for very long pre-tokens
                if last < len(self.leaves):
                    tail = tail + self.leaves[last]
                    last += 1
        keep, at = [], 0
        for i, p in enumerate(tail):
            if at + shift >= met and at >= end - begin:
                keep = tail[i:]
                break
            at += len(p)
        self.encoded += len(fresh)
        self.leaves[first] = head + fresh + keep
        for i in range(first + 1, last):
            self.leaves[i] = []
        for i in range(first, last):
            self._update(i)


def recount(docs: DataFrame, find_edits: Callable[[str], list[tuple[int, int, str]]] = redactions,
            tokenizer: str = TOKENIZER, text_col: str = "text") -> DataFrame:
    """``docs`` with tokens_before, n_edits, tokens_after and n_encoded (pre-tokens that the edits counted anew)."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(tokenizer))
    added = ["tokens_before", "n_edits", "tokens_after", "n_encoded"]
    docs = docs.drop(*added)
    where = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(ranks.value)
        for b in batches:
            rows = []
            for text in b.column(where).to_pylist():
                tree = TokenTree(text or "", counter)
                before = tree.total
                edits = find_edits(text or "")
                for start, end, replacement in reversed(edits):     # from the back, so that places hold
                    tree.edit(start, end, replacement)
                rows.append((before, len(edits), tree.total, tree.encoded))
            new = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *added])

    return docs.mapInArrow(run, schema)


_LEAVES = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("ends", T.ArrayType(T.IntegerType())),
                                    T.StructField("tokens", T.LongType())]))
_TREE = [T.StructField("n_tokens", T.LongType()), T.StructField("leaves", _LEAVES)]
_LEAVES_ARROW = pa.list_(pa.struct([("text", pa.string()), ("ends", pa.list_(pa.int32())), ("tokens", pa.int64())]))
ROWS = 64                   # trees in hand at once


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)


def tree_table(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens and leaves.  Write it once; ``update_trees`` keeps it up to date."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(tokenizer))
    schema = T.StructType([docs.schema[id_col], *_TREE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(ranks.value)
        for b in _runs(batches):
            trees = [TokenTree(t or "", counter) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([t.total for t in trees], pa.int64()),
                 pa.array([t.packed() for t in trees], _LEAVES_ARROW)], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def update_trees(trees: DataFrame, edits: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id") -> DataFrame:
    """``trees`` after ``edits`` (id, start, end, replacement), with n_edits and n_encoded (pre-tokens encoded for them).

    Places count characters of the text before any of these edits.
    """
    ranks = trees.sparkSession.sparkContext.broadcast(load_ranks(tokenizer))
    of_doc = edits.groupBy(F.col(id_col).alias("_eid")).agg(F.sort_array(F.collect_list(
        F.struct("start", "end", F.coalesce("replacement", F.lit("")).alias("replacement")))).alias("_edits"))
    rows = trees.select(id_col, "n_tokens", "leaves").join(of_doc, F.col(id_col) == F.col("_eid"), "left").drop("_eid")
    schema = T.StructType([trees.schema[id_col], *_TREE, T.StructField("n_edits", T.LongType()),
                           T.StructField("n_encoded", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(ranks.value)
        for b in _runs(batches):
            totals, leaves, n_edits, n_encoded = b.column(1).to_pylist(), [], [], []
            for i, todo in enumerate(b.column(3).to_pylist()):
                n_edits.append(len(todo or []))
                if not todo:
                    leaves.append(b.column(2)[i].as_py())
                    n_encoded.append(0)
                    continue
                tree = TokenTree.stored(b.column(2)[i].as_py(), counter)
                _check(todo, tree.chars[1])
                for e in reversed(todo):                            # from the back, so that places hold
                    tree.edit(e["start"], e["end"], e["replacement"])
                totals[i] = tree.total
                leaves.append(tree.packed())
                n_encoded.append(tree.encoded)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(totals, pa.int64()), pa.array(leaves, _LEAVES_ARROW),
                 pa.array(n_edits, pa.int64()), pa.array(n_encoded, pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _check(edits: list[dict], length: int) -> None:
    at = 0
    for e in edits:
        if e["start"] is None or e["end"] is None or not at <= e["start"] <= e["end"] <= length:
            raise ValueError(f"edits must be disjoint and inside the text of {length} characters: {e}")
        at = e["end"]
