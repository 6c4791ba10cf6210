"""Benchmark decontamination: a prefix-filtered containment join, DataFrame functions only.

An item's windows are its runs of ``WINDOW`` consecutive words (one window for
a shorter item).  Words are ordered by rarity over the whole corpus.  A window
can only occur where its rarest word occurs, so that word is its necessary
prefix: only document positions that hold a prefix word of some window are
joined, and nearly all positions drop out at once.  A joined position fixes
how item and document would align; length and positional bounds discard
alignments without room for a window, and the aligned words are then compared
one by one.  The run of equal words around the joined position decides: with a
window's length or more, every window within it occurs.

The index grows with the benchmark, not with the corpus.  It is broadcast when
its measured size is below ``BROADCAST_BYTES``; beyond that, positions are
joined by a shuffle of narrow rows, and words are fetched for candidates only.

Defined cases: null and empty texts have no words (no hits, not
contaminated); items without words have no window; equal (item_id, text) rows
count once; a null item_id makes hits but is not listed; repeated documents
get equal results; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockwatch.llm.common import ascii_lower, join_on_row_key, text_or_empty, with_row_key
from flockwatch.session import materialize

WINDOW = 13
BROADCAST_BYTES = 32 << 20
# The contract's words are the runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F] in lower case; this is what
# separates them.  Splitting is several times cheaper than extracting matches.  Fixed value.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(col: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(col), SEPARATOR), "")


def _fits(df: DataFrame, size: Column) -> bool:
    return (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def _word_counts(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Occurrences in the corpus of the words of the vocabulary (word, n)."""
    occurring = words.select(F.explode_outer("_w").alias("word"))
    if _fits(vocabulary, F.octet_length("word") + 32):
        occurring = occurring.join(F.broadcast(vocabulary), "word")
        return occurring.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return occurring.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(vocabulary, "word")


def _prefix_index(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """One row per item and prefix position: word, q (its position), and the item's words."""
    at = items.select("_item", F.posexplode("_iw").alias("pos", "word"))
    ranked = (at.join(counts, "word", "left")
              .groupBy("_item").agg(F.array_sort(F.collect_list(F.struct(
                  "pos", F.coalesce("n", F.lit(0)).alias("n")))).alias("_r")))
    # Of equally rare words those at multiples of the window: each window holds one, so repeats share a position.
    ranked = ranked.withColumn("_r", F.transform("_r", lambda x: F.struct(
        x["n"].alias("n"), F.pmod(x["pos"], F.lit(window)).alias("m"), x["pos"].alias("q"))))
    length = F.size("_r")
    span = F.least(F.lit(window), length)
    rarest = F.transform(F.sequence(F.lit(0), length - span),
                         lambda s: F.array_min(F.slice("_r", s + 1, span))["q"])
    return (ranked.select("_item", F.explode(F.array_distinct(rarest)).alias("_q"))
            .join(items, "_item")
            .select("_item", "item_id", "_q", "_iw", F.element_at("_iw", F.col("_q") + 1).alias("_word")))


def _verified(candidates: DataFrame, window: int) -> DataFrame:
    """Candidates (``_w``, ``_iw``, ``_p``, ``_q``) whose equal run around the position holds a window: [a, b).

    Only the aligned words leave the join, never a whole document per
    candidate.  The comparison is the argument of a generator, so the optimizer
    cannot move it into the join, where it would keep positions from being
    streamed.
    """
    d = F.col("_p") - F.col("_q")
    span = F.least(F.lit(window), F.size("_iw"))
    lo, hi = F.greatest(F.lit(0), -d), F.least(F.size("_iw"), F.size("_w") - d)
    others = [c for c in candidates.columns if c not in ("_w", "_p", "_word")]
    aligned = (candidates.where(hi - lo >= span)
               .select(*others, d.alias("_d"), lo.alias("_lo"), hi.alias("_hi"),
                       F.slice("_w", d + lo + 1, hi - lo).alias("_s")))
    d, q, lo, hi = (F.col(c) for c in ("_d", "_q", "_lo", "_hi"))
    differ = F.filter(F.sequence(lo, hi - 1), lambda j: F.get(F.col("_s"), j - lo) != F.get(F.col("_iw"), j))
    run = F.transform(F.array(differ), lambda x: F.struct(
        (F.coalesce(F.array_max(F.filter(x, lambda j: j < q)), lo - 1) + 1 + d).alias("a"),
        (F.coalesce(F.array_min(F.filter(x, lambda j: j > q)), hi) + d).alias("b")))
    return aligned.select("*", F.inline(F.filter(run, lambda r: r["b"] - r["a"] >= span)))


def benchmark_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                   id_col: str = "doc_id") -> DataFrame:
    """(id, _th, n_hit, items) of the documents with hits; ``docs`` has id, ``_th`` and text."""
    items = (items.select(F.col("item_id"), words_of(text_or_empty()).alias("_iw"))
             .where(F.size("_iw") > 0).distinct()
             .withColumn("_item", F.xxhash64("item_id", "_iw")))
    items = materialize(items, "items")
    words = docs.select(id_col, "_th", words_of(text_or_empty()).alias("_w"))
    vocabulary = materialize(items.select(F.explode("_iw").alias("word")).distinct(), "vocabulary")
    counts = materialize(_word_counts(words, vocabulary), "word-counts")
    index = materialize(_prefix_index(items, counts, window), "prefix-index")
    # Outer, so that no filter on the size of the words makes them be split twice.
    positions = words.select(id_col, "_th", "_w", F.posexplode_outer("_w").alias("_p", "_word"))
    if _fits(index, F.octet_length(F.array_join("_iw", " ")) + 16 * F.size("_iw") + 64):
        found = _verified(positions.join(F.broadcast(index), "_word"), window)
    else:
        narrow = (positions.select(id_col, "_th", "_p", "_word")
                  .join(index.select("_word", "_item", "_q"), "_word")
                  .select(id_col, "_th", "_p", "_item", "_q"))
        # The documents' words come last, so that no row that carries them is shuffled again.
        fetched = join_on_row_key(narrow.join(items, "_item"), words, id_col, "inner")
        found = _verified(fetched, window)
    per_doc = (found.select(id_col, "_th", "item_id", "a", "b")
               .groupBy(id_col, "_th")
               .agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("runs"),
                    F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("runs", zero, lambda acc, r: F.struct(
        F.greatest(acc["end"], r["b"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], acc["end"])).cast("long")).alias("n")))
    return per_doc.select(id_col, "_th", covered["n"].alias("n_hit"), "items")


def _is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                  id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, item ids and the contamination rule."""
    keyed = with_row_key(docs, id_col).select(id_col, "_th", "text")
    hits = benchmark_hits(keyed, items, window, id_col)
    sized = keyed.select(id_col, "_th", F.size(words_of(text_or_empty()))
                         .cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    out = (join_on_row_key(sized, hits, id_col)
           .withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))
           .withColumn("items", F.coalesce("items", none)))
    return out.select(id_col, "_th", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
                      _is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                   id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the contaminated documents."""
    keyed = with_row_key(docs, id_col)
    hits = benchmark_hits(keyed.select(id_col, "_th", "text"), items, window, id_col).select(id_col, "_th", "n_hit")
    n_words = F.size(words_of(text_or_empty()))
    # Only the few documents with hits are on the right side.
    out = join_on_row_key(keyed, hits, id_col)
    return out.where(~F.coalesce(_is_contaminated(F.col("n_hit"), n_words), F.lit(False))).select(*docs.columns)
