"""Plain versions of the contracts, for comparison."""

import collections
import re

import xxhash

WHITE = "[\x20\x09-\x0d]+"


def words(text):
    return [w for w in re.split(WHITE, text or "") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def substring_dedup(rows, length=50):
    """[(id, text)] to [(id, n_words, n_removed, kept)], in order of rows."""
    first = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - length + 1):
            x = hash(tuple(w[j : j + length]))
            if i is not None:
                first[x] = min(first.get(x, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - length + 1):
            if i is not None and first[hash(tuple(w[j : j + length]))] < i:
                gone[j : j + length] = [True] * length
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def byte_dedup(rows, length=400):
    """[(id, text)] to [(id, n_bytes, n_removed, n_spans, kept)]"""
    seen = collections.Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(hash(b[j : j + length]) for j in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if seen[hash(b[j : j + length])] > 1:
                gone[j : j + length] = b"\1" * length
        spans = sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def clean(rows, length):
    """[(id, text)] without byte strings that occur twice, but characters of which a part repeats stay whole."""
    seen, data, out = collections.Counter(), [t.encode() for _, t in rows], []
    for b in data:
        seen.update(hash(b[j : j + length]) for j in range(len(b) - length + 1))
    for (i, _), b in zip(rows, data, strict=True):
        runs = []
        for j in range(len(b) - length + 1):
            if seen[hash(b[j : j + length])] > 1:
                if runs and j <= runs[-1][1]:
                    runs[-1][1] = j + length
                else:
                    runs.append([j, j + length])
        kept, at = b"", 0
        for x, y in runs:
            while x < y and b[x] & 0xC0 == 0x80:
                x += 1
            while x < y < len(b) and b[y] & 0xC0 == 0x80:
                y -= 1
            kept, at = kept + b[at:x], y
        out.append((i, (kept + b[at:]).decode()))
    return out


def fingerprint(text):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, distance=2):
    """[(id, fingerprint)] to [component id]"""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= distance:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(fps))]


def rule_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = collections.Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)
