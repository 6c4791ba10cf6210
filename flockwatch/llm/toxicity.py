"""Toxicity scores: FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features of a text are its distinct words, word pairs and pairs that skip one
word, hashed into ``2**BITS`` coordinates.  Training is FTRL-proximal with
per-coordinate learning rates and L1, so most weights are exactly zero and the
model is a short list of (coordinate, weight) that is broadcast for scoring.

The model is fitted on at most ``MAX_TRAIN_ROWS`` labelled documents, those of
the smallest id hash; features are extracted in parallel, and one task runs
the sequential updates over the bounded sample.  Scoring reads every text
whole.  Only ``labels.toxic`` of documents outside the held-out fifth
(crc32 of the id modulo 5 is 0) is learned; labels, language, source and id
are never inputs of a score.

Defined cases: null and empty texts have no features and score as the bias
says; documents whose id is null are never held out and never trained on;
several labels of one id count as toxic if any is; several rows of one
training id train once; without training rows every score is 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flockwatch.llm.common import slices, text_or_empty
from flockwatch.session import materialize

BITS = 22
MAX_TRAIN_ROWS = 16384
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 0.1
FOLDS = 5
RUN = 1 << 16               # words hashed at once
SLICE = 1 << 20             # bytes of text scored at once
KNOWN = 50_000              # words whose hashes a task remembers

_WORD = re.compile(r"\w+")


class _Hashes(dict):
    """Word to hash; emptied when it holds too many words, so memory stays bounded."""

    def __missing__(self, word):
        if len(self) >= KNOWN:
            self.clear()
        h = self[word] = (zlib.crc32(word.encode()) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        return h


def _words(text: str) -> Iterator[list[str]]:
    """The words in runs of ``RUN``; a run begins with the last two words of the one before."""
    run = []
    for m in _WORD.finditer(text.lower()):
        run.append(m.group())
        if len(run) == RUN:
            yield run
            run = run[-2:]
    yield run


def features(text: str, hashes: _Hashes) -> np.ndarray:
    """Coordinates of a text's words, pairs and skip pairs; repeats stay in."""
    return np.concatenate([_coordinates(run, hashes) for run in _words(text)])


def _coordinates(words: list[str], hashes: _Hashes) -> np.ndarray:
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    shift = np.uint64(64 - BITS)
    mul, pair, skip = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
    with np.errstate(over="ignore"):
        mixed = h * mul
        two = (h[:-1] * pair + mixed[1:]) * mul
        gap = (h[:-2] * skip + mixed[2:]) * mul
    return (np.concatenate((mixed, two, gap)) >> shift).astype(np.int32)


def held_out(id_col: str = "doc_id") -> Column:
    rest = F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS
    return F.coalesce(rest == 0, F.lit(False))


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-max(-35.0, min(35.0, x))))


class Ftrl:
    """FTRL-proximal state; coordinate ``2**BITS`` is the bias, without L1."""

    def __init__(self, bits: int = BITS):
        self.z = np.zeros((1 << bits) + 1)
        self.n = np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, L1)
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0.0)
        return -shrunk / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = _sigmoid(float(w.sum())) - label
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g

    def kept(self) -> np.ndarray:
        """Coordinates whose weight may not be zero, and the bias; no copy of the state is made for it."""
        bias = len(self.z) - 1
        return np.append(np.flatnonzero((self.z[:-1] > L1) | (self.z[:-1] < -L1)), bias)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The model: (coordinate, weight), weights that are not zero; empty without training rows."""
    sample = (labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(id_col))
              .groupBy(id_col).agg(F.max("toxic").cast("double").alias("_y"))
              .withColumn("_o", F.xxhash64(F.lit(1), id_col))
              .orderBy("_o", id_col).limit(MAX_TRAIN_ROWS))
    sample = materialize(sample.select(F.col(id_col).alias("_sid"), "_y", "_o"), "toxicity-sample")
    # At most MAX_TRAIN_ROWS narrow rows are broadcast.
    texts = (docs.select(F.col(id_col), text_or_empty(text_col).alias("_t"))
             .join(F.broadcast(sample), F.col(id_col) == F.col("_sid"))
             .groupBy("_sid", "_y", "_o").agg(F.min("_t").alias("_t")))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            for part in slices(b, 2, SLICE):
                ats = [np.unique(features(t, hashes)) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ats, pa.list_(pa.int32()))],
                                                 ["_o", "_y", "_at"])

    rows = materialize(texts.select("_o", "_y", "_t").mapInArrow(extract, "_o long, _y double, _at array<int>"),
                       "toxicity-features")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, labels_, ats = [], [], []
        for b in batches:
            order += b.column(0).to_pylist()
            labels_ += b.column(1).to_pylist()
            ats += [x.values.to_numpy() for x in b.column(2)]
        model = Ftrl()
        bias = np.array([len(model.z) - 1])
        for _ in range(EPOCHS):
            for i in np.argsort(np.array(order, np.int64), kind="stable"):
                model.learn(np.concatenate((ats[i], bias)), labels_[i])
        at = model.kept() if order else np.zeros(0, int)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(model.weights(at))],
                                         ["coordinate", "weight"])

    return rows.coalesce(1).mapInArrow(train, "coordinate long, weight double")


def score(docs: DataFrame, model: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``score`` (0 to 1; higher: more likely toxic)."""
    rows = model.collect()      # 2**BITS + 1 rows at most, and L1 keeps few of them
    at = np.array([r[0] for r in rows], np.int64)
    weight = np.array([r[1] for r in rows], np.float64)
    sent = docs.sparkSession.sparkContext.broadcast((at, weight))
    docs = docs.drop("score")
    where = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weight = sent.value
        # Few coordinates have a weight, so a flag for each will do, and the weights are looked up.
        order = np.argsort(at)
        at, weight = at[order], weight[order].astype(np.float32)
        known = np.zeros(1 << BITS, bool)
        known[at[:-1]] = weight[:-1] != 0
        bias = float(weight[-1]) if len(at) else 0.0
        hashes = _Hashes()
        for b in batches:
            for part in slices(b, where, SLICE):
                scores = np.zeros(part.num_rows)
                if len(at):
                    for i, t in enumerate(part.column(where)):
                        f = features(t.as_py() or "", hashes)
                        f = np.unique(f[known[f]])
                        scores[i] = _sigmoid(float(weight[np.searchsorted(at, f)].sum()) + bias)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], schema=None,
                                                 names=[*part.schema.names, "score"])

    return docs.mapInArrow(apply, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    model = materialize(fit(docs, labels, id_col, text_col), "toxicity-model")
    scored = score(docs.drop("held_out", "predicted"), model, text_col)
    return scored.withColumns({"held_out": held_out(id_col), "predicted": (F.col("score") >= 0.5).cast("int")})


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents predicted toxic."""
    columns = docs.columns
    return toxicity(docs, labels, id_col, text_col).where(F.col("predicted") == 0).select(*columns)
