"""Byte-level BPE encoding and decoding by merge replay over the words of a whole slice of the corpus.

Texts are split by the vocabulary's pattern; the distinct words of a task's
run of documents stand in one array of symbols.  An inverted index leads from
the rank of a token pair to all its positions in all words; ranks are taken in
ascending order, merges are applied at all places at once, and only the two
neighbours of a merged place enter the index anew.  Ranks are taken in
``WINDOWS`` runs, and within a run each word replays its lowest rank per round.
Words longer than ``SHORT`` bytes would need many rounds, so they are replayed
one rank at a time.  Words keep their ids for the following documents of the
task, so a word is replayed once per slice, however often it stands there.  No row is shuffled: a table of all
words of the corpus would have to reach every document by a shuffle of the
text or of all (document, word) pairs, which costs more than replaying shared
words once per task.

The result is that of per-word byte pair encoding: of the pairs a word holds,
the lowest rank goes first, the leftmost among equals.  A merge may bring up a
pair of lower rank (the same bytes split another way); then the word's other
places wait until that rank has been replayed.

Defined cases: a null or empty text has no tokens; strings of special tokens
are ordinary text; repeated rows and ids give a row each; an empty table gives
an empty result; other columns are neither read nor returned, so their names
cannot clash.  A very long text is split in runs of ``CHUNK`` words, and a
word of any length costs about n log n.  A null list of ids decodes to empty
bytes; an id that the vocabulary lacks fails the job.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flockwatch.llm.common import slices

# Documents are encoded in slices of about this much text; a task remembers at
# most this many words and this many bytes of them between slices.
SLICE_BYTES = 3 << 20
KNOWN_WORDS = 400_000
KNOWN_BYTES = 16 << 20
# Words of a very long text taken at once.
CHUNK = 200_000
LONG_TEXT = 4 << 20
# Words of up to so many bytes are replayed together, in so many runs of ranks.
SHORT = 96
WINDOWS = 8
NONE = np.int32(np.iinfo(np.int32).max)     # rank of a pair that is no token


class Vocabulary:
    """Ranks (bytes to id) and the pattern that splits texts into words."""

    def __init__(self, rank_lines: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_lines.splitlines())}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.width = max(self.bytes_of) + 1
        self.base = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.pattern = regex.compile(pattern)
        self._pairs: dict[int, int] = {}

    def pair_rank(self, key: int) -> int:
        """Rank of the token pair ``key`` = first * width + second, or -1."""
        r = self._pairs.get(key)
        if r is None:
            a, b = divmod(key, self.width)
            r = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
            if len(self._pairs) >= 1 << 18:
                self._pairs.clear()
            self._pairs[key] = r
        return r

    @cached_property
    def _merges(self) -> tuple[np.ndarray, np.ndarray]:
        """All token pairs (first * width + second, ascending) that make a token, and their ranks."""
        keys, made, ranks = [], [], self.ranks
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    made.append(r)
        keys, made = np.array(keys, np.int64), np.array(made, np.int32)
        order = np.argsort(keys)
        # The last key is no pair's, so that every search ends inside.
        return np.append(keys[order], np.iinfo(np.int64).max), np.append(made[order], NONE)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the token pairs, or ``NONE``."""
        keys, made = self._merges
        wanted = a * np.int64(self.width) + b
        at = np.searchsorted(keys, wanted)
        return np.where(keys[at] == wanted, made[at], NONE)


@lru_cache(maxsize=2)
def vocabulary(rank_lines: bytes, pattern: str) -> Vocabulary:
    """The vocabulary, built once per Python worker and not once per task."""
    return Vocabulary(rank_lines, pattern)


def replay(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of distinct, non-empty words: all merges in rank order over all words at once."""
    whole = np.array([vocab.ranks.get(w, -1) for w in words], dtype=np.int32)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    parts = [(np.flatnonzero(whole >= 0), whole[whole >= 0], np.ones((whole >= 0).sum(), np.int64))]
    for mask, one in (((whole < 0) & (sizes <= SHORT), _replay_short), ((whole < 0) & (sizes > SHORT), _replay_long)):
        which = np.flatnonzero(mask)
        if len(which):
            parts.append((which, *one([words[i] for i in which.tolist()], vocab)))
    n = np.zeros(len(words), np.int64)
    for which, _, counts in parts:
        n[which] = counts
    offsets = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(offsets[-1], np.int32)
    for which, ids, counts in parts:
        out[np.repeat(offsets[which] - np.cumsum(counts) + counts, counts) + np.arange(len(ids))] = ids
    return out, offsets


def _replay_short(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, their number by word): runs of ranks in ascending order, one merge of each word per round."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.cumsum(sizes)
    n = int(ends[-1])
    ids = vocab.base[np.frombuffer(b"".join(words), dtype=np.uint8)].astype(np.int32)
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    nxt[ends - 1], prv[ends - sizes] = -1, -1
    # Rank of the pair that begins at a place; a place stands in the index under the run of that rank.
    rank = np.full(n, NONE)
    at = np.flatnonzero(nxt >= 0).astype(np.int32)
    rank[at] = vocab.pair_ranks(ids[at], ids[at + 1])
    known = rank[at][rank[at] < NONE]
    bounds = np.unique(np.quantile(known, np.arange(1, WINDOWS) / WINDOWS).astype(np.int32)) if len(known) else known
    bounds = np.append(bounds, NONE)
    index: list[list[np.ndarray]] = [[] for _ in bounds]

    def enter(places: np.ndarray) -> None:
        places = places[rank[places] < NONE]
        run = np.searchsorted(bounds, rank[places], side="right").astype(np.int16)
        order = np.argsort(run, kind="stable")
        places, run = places[order], run[order]
        cuts = np.flatnonzero(np.diff(run, prepend=-1))
        for r, part in zip(run[cuts].tolist(), np.split(places, cuts[1:]) if len(cuts) else (), strict=True):
            index[r].append(part)

    enter(at)
    for run, high in enumerate(bounds):
        places = np.concatenate(index[run]) if index[run] else at[:0]
        index[run], later = [], []
        while True:
            places = np.sort(places)
            places = places[np.diff(places, prepend=-1) != 0]
            places = places[rank[places] < high]
            if not len(places):
                break
            # No word has a pair of an earlier run left, so its lowest rank, and of equal ones the leftmost, is next.
            r, w = rank[places], word[places]
            first = np.flatnonzero(np.diff(w, prepend=-1))
            least = np.minimum.reduceat(r, first)
            low = np.flatnonzero(r == np.repeat(least, np.diff(first, append=len(r))))
            p = places[low[np.diff(w[low], prepend=-1) != 0]]
            q, left = nxt[p], prv[p]
            s = nxt[q]
            ids[p], ids[q], nxt[p], rank[q], rank[p] = least, -1, s, NONE, NONE
            more = s >= 0
            prv[s[more]] = p[more]
            rank[p[more]] = vocab.pair_ranks(least[more], ids[s[more]])
            more = left >= 0
            left = left[more]
            rank[left] = vocab.pair_ranks(ids[left], least[more])
            new = np.concatenate((p, left))
            later.append(new[rank[new] >= high])
            places = np.concatenate((places, left))
        if later:
            enter(np.concatenate(later))
    live = ids >= 0
    return ids[live], np.bincount(word[live], minlength=len(words))


def _replay_long(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, their number by word): one rank after the other, each at all its places."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.cumsum(sizes)
    n = int(ends[-1])
    first_ids = vocab.base[np.frombuffer(b"".join(words), dtype=np.uint8)]
    last = np.zeros(n, dtype=bool)
    last[ends - 1] = True
    # The inverted index: rank -> positions of the pairs of that rank.
    at = np.flatnonzero(~last)
    keys, which = np.unique(first_ids[at] * vocab.width + first_ids[np.minimum(at + 1, n - 1)], return_inverse=True)
    rank = np.array([vocab.pair_rank(k) for k in keys.tolist()], dtype=np.int64)[which] if len(at) else at
    at, rank = at[rank >= 0], rank[rank >= 0]
    order = np.argsort(rank, kind="stable")
    at, rank = at[order], rank[order]
    cuts = np.flatnonzero(np.diff(rank, prepend=-1))
    index = {int(rank[c]): x.tolist() for c, x in zip(cuts, np.split(at, cuts[1:]), strict=True)} if len(at) else {}
    heap = list(index)
    heapify(heap)

    ids = first_ids.tolist()
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    nxt[last] = -1
    prv[ends - sizes] = -1
    nxt, prv, word_ends = nxt.tolist(), prv.tolist(), (ends - 1).tolist()
    width, pair_rank, known = vocab.width, vocab.pair_rank, vocab._pairs
    while heap:
        r = heappop(heap)
        places = index.pop(r, None)
        if places is None:
            continue
        places.sort()
        wait, later = -1, []
        for p in places:
            q = nxt[p]
            if q < 0:
                continue
            first = ids[p]
            if first < 0:
                continue
            key = first * width + ids[q]
            if known.get(key, -2) != r and pair_rank(key) != r:
                continue
            if p <= wait:
                later.append(p)
                continue
            s, left = nxt[q], prv[p]
            ids[p], ids[q], nxt[p] = r, -1, s
            low = r
            if left >= 0:
                key = ids[left] * width + r
                x = known.get(key)
                if x is None:
                    x = pair_rank(key)
                if x >= 0:
                    if x in index:
                        index[x].append(left)
                    else:
                        index[x] = [left]
                        heappush(heap, x)
                    low = min(low, x)
            if s >= 0:
                prv[s] = p
                key = r * width + ids[s]
                x = known.get(key)
                if x is None:
                    x = pair_rank(key)
                if x >= 0:
                    if x in index:
                        index[x].append(p)
                    else:
                        index[x] = [p]
                        heappush(heap, x)
                    low = min(low, x)
            if low < r:
                wait = word_ends[bisect_left(word_ends, p)]
        if later:
            if r in index:
                index[r] += later
            else:
                index[r] = later
                heappush(heap, r)
    out = np.array(ids, dtype=np.int32)
    live = out >= 0
    return out[live], np.add.reduceat(live.astype(np.int64), ends - sizes)


class _Words(dict):
    """Word -> number, in order of first sight."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


class Encoder:
    """Encodes runs of texts; keeps the ids of the words it has seen, up to a bound."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._forget()

    def _forget(self):
        self.words = _Words()
        self.ids = [np.zeros(0, np.int32)]
        self.sizes = [np.zeros(0, np.int64)]
        self.n_known = self.n_bytes = 0

    def _numbers(self, text: str) -> np.ndarray:
        """Numbers of the words of a text, in order."""
        number = self.words.__getitem__
        if len(text) < LONG_TEXT:
            found = self.vocab.pattern.findall(text)
            return np.fromiter(map(number, found), dtype=np.int32, count=len(found))
        parts, found = [], (m.group() for m in self.vocab.pattern.finditer(text))
        while len(part := np.fromiter(map(number, islice(found, CHUNK)), dtype=np.int32)):
            parts.append(part)
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) over the texts."""
        if self.n_known > KNOWN_WORDS or self.n_bytes > KNOWN_BYTES:
            self._forget()
        numbers = [self._numbers(t or "") for t in texts]
        new = [w.encode() for w in islice(self.words, self.n_known, None)]
        if new:
            ids, offsets = replay(new, self.vocab)
            self.ids, self.sizes = [np.concatenate((*self.ids, ids))], [np.concatenate((*self.sizes, np.diff(offsets)))]
            self.n_known += len(new)
            self.n_bytes += sum(map(len, new))
        ids, sizes = self.ids[0], self.sizes[0]
        starts = np.cumsum(sizes) - sizes
        out = []
        for words in numbers:
            n = sizes[words]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(words) else 0
            out.append(ids[np.repeat(starts[words] - ends + n, n) + np.arange(total)])
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int64)
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), offsets


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) per row; ``rank_file`` names a file of base64 tokens and ranks that the driver reads.

    The vocabulary is broadcast: its size is that of the file, whatever the input.
    """
    with open(rank_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(*shared.value))
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                ids, offsets = encoder.encode(part.column(1).to_pylist())
                lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(offsets)), lists.cast(pa.list_(pa.int32()))],
                    names=[id_col, "n_tokens", "ids"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(id_col, docs[text_col].cast("string").alias("_text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, rank_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``: the bytes of its ids, in order."""
    with open(rank_file, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())
    others = [c for c in encoded.columns if c != "decoded"]
    at = others.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = vocabulary(shared.value, "").bytes_of.__getitem__
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [b"".join(map(token, x.values.to_numpy(zero_copy_only=False).tolist())) if x.is_valid else b""
                         for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*others, "decoded"])

    schema = T.StructType([encoded.schema[c] for c in others] + [T.StructField("decoded", T.BinaryType())])
    return encoded.select(*others).mapInArrow(run, schema)
