"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import re

SPACE = " \t\n\x0b\x0c\r"


def lower(t):
    return t.encode().lower().decode()


def lines(rows):
    owner, ids = {}, collections.defaultdict(set)
    key = [[lower(x.strip(SPACE)) for x in (t or "").split("\n")] for _, t in rows]
    for (i, _), ks in zip(rows, key, strict=True):
        for k in ks:
            if len(k) >= 10:
                ids[k].add(i)
    for k, s in ids.items():
        known = [i for i in s if i is not None]
        if len(s) > 1 and known:
            owner[k] = min(known)
    out = []
    for (i, t), ks in zip(rows, key, strict=True):
        xs = (t or "").split("\n")
        kept = [x for x, k in zip(xs, ks, strict=True) if k not in owner or owner[k] == i]
        out.append((i, len(xs), len(xs) - len(kept), sha("\n".join(kept).encode())))
    return out


def sha(b):
    return hashlib.sha256(b).hexdigest()


def repeats(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    count = collections.Counter(b[s:s + length] for b in texts for s in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s:s + length]] > 1:
                gone[s:s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, sha(kept)))
    return out


def shingles(t):
    w = (t or "").encode().lower().split()
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def components(ids, pairs):
    """Smallest id per component; null only where no id is known."""
    of = roots(len(ids), pairs)
    least = {}
    for i, r in zip(ids, of, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [least.get(r) for r in of]


def jaccard(rows):
    sets = [shingles(t) for _, t in rows]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    names = components([i for i, _ in rows], pairs)
    return [(i, len(s), c) for (i, _), s, c in zip(rows, sets, names, strict=True)]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(rows, items, window=13):
    known = collections.defaultdict(set)
    for item, t in items:
        w = WORD.findall(lower(t or ""))
        k = min(window, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            known[tuple(w[s:s + k])].add(item)
    sizes = {len(k) for k in known}
    out = []
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        hit, found = set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                got = known.get(tuple(w[s:s + k]))
                if got:
                    hit |= set(range(s, s + k))
                    found |= {str(x) for x in got if x is not None}
        ids = ",".join(sorted(found))
        out.append((i, len(w), len(hit), len(found), sha(ids.encode()), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out
