"""Plain, slow versions of what the operators compute."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(_LOWER)


def words(text):
    return WORD.findall(text or "")


def fingerprint(text):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def components(fps):
    """Root index of each index, linking fingerprints at most 4 bits apart."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def kept_words(texts, length=35):
    """Kept words of each text after removing every word in a repeated window."""
    split = [words(t) for t in texts]
    count = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for w in split:
        gone = {k for i in range(len(w) - length + 1) if count[tuple(w[i : i + length])] > 1 for k in range(i, i + length)}
        out.append([x for k, x in enumerate(w) if k not in gone])
    return out


def contamination(text, items):
    """n_words, n_hit, item ids of a text against (id, text) items."""
    w = ALNUM.findall(lower(text))
    places = defaultdict(list)
    hit, found = set(), set()
    windows = []
    for item_id, item in items:
        v = ALNUM.findall(lower(item))
        n = min(13, len(v))
        windows += [(tuple(v[i : i + n]), str(item_id)) for i in range(len(v) - n + 1) if n]
    for n in {len(x) for x, _ in windows}:
        for i in range(len(w) - n + 1):
            places[tuple(w[i : i + n])].append(i)
    for x, item_id in windows:
        for i in places.get(x, ()):
            hit |= set(range(i, i + len(x)))
            found.add(item_id)
    return len(w), len(hit), sorted(found)
