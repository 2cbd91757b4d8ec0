"""BPE encoding by speculation and verification, and decoding.

For a vocabulary with word ends: NFC, white space to one space, lower case, a fixed split, bytes as
printable characters, merges. White space always parts pre-tokens, so a text is encoded word by word. Words of printable ASCII are
split into pre-tokens in numpy arrays, all at once; each distinct pre-token (or other word) of a batch is encoded once, and a bounded
table keeps common ones.

New pre-tokens: greedy longest match proposes tokens. A sequence of tokens is what the merges give if and only
if every adjacent pair is what they give for the pair alone, so all adjacent pairs of all words are tested in
numpy arrays: walking back in time along the pair's inner edges, no merge across the border may come
before the merges that closed those edges. Only words with a failing pair are merged exactly, many at a time: each round of
array operations makes the first of the lowest merges in every one of them.

Cases: null and empty texts have no tokens and decode to nothing. The special tokens' strings in a text are
their ids. Repeated rows and null doc_ids keep a row each; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import load, pieces, trimmed, utf8, words

#: Entries in the table of a Python worker; when it is full, those met again since the last time stay. Longer ones are not kept.
TABLE_WORDS, TABLE_BYTES_EACH = 250_000, 32
#: Bytes of text whose distinct pre-tokens are looked up together.
TABLE_BYTES = 1 << 21
#: Characters of the longest word that is merged together with others.
BATCH_CHARS = 48
VOCABULARY = "word_bpe_49k.json"

_END = "</w>"
#: The split (a fixed value of such vocabularies) that `split_plain` follows; with any other, all words take the general way.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Kinds of lower-cased printable ASCII bytes: 1 letters, 2 digits, 3 the rest; 0 for what takes the general way.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[97:123] = 1
_KIND[ord("'")] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NEVER = np.iinfo(np.int64).max


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The printable character of each byte: itself where printable in Latin-1, else the next from U+0100."""
    spare = iter(range(256, 512))
    return [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else chr(next(spare)) for b in range(256)]


def spread_rows(sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The places of runs of the given starts and sizes, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*self.vocab.values(), *special.values()]) + 1
        names = [""] * size
        for name, i in [*self.vocab.items(), *special.items()]:
            names[i] = name
        self.ends_word = np.array([x.endswith(_END) for x in names])
        self.names = pa.array([f"{x} " for x in names])  # a space ends each, so that rows of them are joined
        self.special = special
        self.proposed = self.failed = 0  # pre-tokens so far, and those that had to be merged
        if any(len(x.split()) != 1 for x in special):
            raise ValueError("a special token with white space")
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self._split = regex.compile(pattern)
        self._split_lines = regex.compile("\n|" + pattern)
        self._kind = _KIND.copy() if pattern == _SPLIT else np.zeros(256, np.uint8)
        self._kind[[x.encode()[0] for x in special]] = 0
        self._chars = dict(enumerate(byte_characters()))
        self._longest = max(map(len, self.vocab))
        # merges[i] makes a token; its place in time is i
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.time = np.full(size, -1, np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for at, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merge[a, b] = (at, c)
            self.left[c], self.right[c], self.time[c] = a, b, at
        self._size = size
        keys = np.array([a * size + b for a, b in self.merge])
        order = np.argsort(keys)
        self._keys, self._when = keys[order], np.array([x[0] for x in self.merge.values()])[order]
        self._made = np.array([x[1] for x in self.merge.values()])  # by time
        self._build_trie()

    def _build_trie(self) -> None:
        """Of the vocabulary's strings: edges (node * 512 + character, sorted), and each node's token inside and at the end of a word."""
        edges: dict[int, int] = {}
        inside, last = [-1], [-1]
        for name, i in self.vocab.items():
            node, ends = 0, name.endswith(_END)
            for c in name.removesuffix(_END):
                key = node * 512 + ord(c)
                if key not in edges:
                    edges[key] = len(inside)
                    inside.append(-1)
                    last.append(-1)
                node = edges[key]
            (last if ends else inside)[node] = i
        self._inside, self._last = np.array(inside), np.array(last)
        keys = np.array(list(edges))
        order = np.argsort(keys)
        self._edge, self._node = keys[order], np.array(list(edges.values()))[order]

    def _time_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """When a and b merge."""
        key = a * self._size + b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._when[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a and b together gives just a, b."""
        never = _NEVER
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        x_gone, y_gone = np.full(len(a), never), np.full(len(a), never)
        while len(live):
            when = self._time_of(x, y)
            # Of equal merges the left comes first: one across the border precedes that of y, not that of x.
            crossed = (when < x_gone) & (when <= y_gone) & (when < never)
            ok[live[crossed]] = False
            tx, ty = self.time[x], self.time[y]
            on = ~crossed & ((tx >= 0) | (ty >= 0))
            live, x, y, x_gone, y_gone, tx, ty = (z[on] for z in (live, x, y, x_gone, y_gone, tx, ty))
            back = ty >= tx
            y_gone, x_gone = np.where(back, ty, y_gone), np.where(back, x_gone, tx)
            x, y = np.where(back, x, self.right[x]), np.where(back, self.left[y], y)
        return ok

    def _propose(self, word: str) -> list[int]:
        vocab, n, i, out = self.vocab, len(word), 0, []
        if (whole := vocab.get(word + _END)) is not None:
            return [whole]
        while i < n:
            j = min(n, i + self._longest)
            if j == n:
                t = vocab.get(word[i:] + _END)
                if t is not None:
                    out.append(t)
                    break
                j = n - 1
            while (t := vocab.get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def propose_together(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The greedy longest matches of many words at a time: all walk the trie of the vocabulary together, and go back to the
        last token seen when there is no way on. (tokens, one word after the other; number of each word's)"""
        long = [i for i, u in enumerate(units) if len(u) > BATCH_CHARS]
        size = np.fromiter(map(len, units), np.int64, len(units))
        size[long] = 0
        stop = np.cumsum(size)
        chars = np.frombuffer("".join(["" if len(u) > BATCH_CHARS else u for u in units]).encode("utf-16-le"), "<u2").astype(np.int64)
        who = np.flatnonzero(size)
        at, stop = (stop - size)[who], stop[who]
        node, token, back = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64), at.copy()
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.array([i] * len(x)), np.array(x)) for i in long for x in [self._propose(units[i])]]
        while len(who):
            key = node * 512 + chars[np.minimum(at, stop - 1)]
            edge = np.minimum(np.searchsorted(self._edge, key), len(self._edge) - 1)
            on = (self._edge[edge] == key) & (at < stop)
            node = np.where(on, self._node[edge], 0)
            at = at + on
            seen = np.where(at == stop, self._last[node], self._inside[node])
            some = on & (seen >= 0)
            token, back = np.where(some, seen, token), np.where(some, at, back)
            if not on.all():
                found.append((who[~on], token[~on]))
                at = np.where(on, at, back)
                left = on | (at < stop)
                if not left.all():
                    who, at, stop, node, token, back = (x[left] for x in (who, at, stop, node, token, back))
        owner, tokens = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return tokens[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(units))

    def merge_exactly(self, word: str) -> list[int]:
        """Lowest merge first, leftmost on ties, over a linked list."""
        token: list[int] = [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + _END]]
        n = len(token)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(m[0], i, token[i], token[i + 1]) for i in range(n - 1) if (m := self.merge.get((token[i], token[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or token[i] != a or token[j] != b:
                continue
            token[i], alive[j], after[i] = self.merge[a, b][1], False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := self.merge.get((token[i], token[after[i]])):
                    heapq.heappush(heap, (m[0], i, token[i], token[after[i]]))
            if before[i] >= 0 and (m := self.merge.get((token[before[i]], token[i]))):
                heapq.heappush(heap, (m[0], before[i], token[before[i]], token[i]))
        return [t for t, x in zip(token, alive, strict=True) if x]

    def merge_together(self, units: list[str]) -> list[list[int]]:
        """merge_exactly of many words at a time, those of like length together."""
        out: list[list[int]] = [[] for _ in units]
        size = np.fromiter(map(len, units), np.int64, len(units))
        for i in np.flatnonzero(size > BATCH_CHARS).tolist():
            out[i] = self.merge_exactly(units[i])
        order = np.argsort(size, kind="stable")
        order = order[size[order] <= BATCH_CHARS]
        vocab = self.vocab
        for own in np.split(order, np.flatnonzero(np.diff(size[order] // 4)) + 1) if len(order) else []:
            n, m = size[own], int(size[own[-1]])
            token = np.zeros((len(own), m + 1), np.int64)
            inside = np.arange(m + 1) < n[:, None]
            token[inside] = [vocab[c] for i in own.tolist() for c in units[i]]
            token[np.arange(len(own)), n - 1] = [vocab[units[i][-1] + _END] for i in own.tolist()]
            when = np.where(inside[:, 1:], self._time_of(token[:, :-1], token[:, 1:]), _NEVER)
            row = np.arange(len(own))  # of the words that still merge, in the arrays
            live, done = own, [None] * len(own)
            places = np.arange(m + 1)
            where = np.arange(len(own))
            while True:
                at = when.argmin(1) if m > 1 else np.zeros(len(row), np.int64)
                first = when[row, at] if m > 1 else np.full(len(row), _NEVER)
                over = first == _NEVER
                if over.any():
                    for w, t, k in zip(where[over].tolist(), token[over].tolist(), n[over].tolist(), strict=True):
                        done[w] = t[:k]
                    token, when, n, at, first, where = (x[~over] for x in (token, when, n, at, first, where))
                    row = np.arange(len(n))
                if not len(n):
                    break
                n = n - 1
                behind = places[None, :-1] > at[:, None]
                token[:, :-1] = np.where(behind, token[:, 1:], token[:, :-1])
                token[row, at] = self._made[first]
                when[:, :-1] = np.where(behind[:, :-1], when[:, 1:], when[:, :-1])
                when[:, -1] = _NEVER
                after = np.where(at + 1 < n, self._time_of(token[row, at], token[row, np.minimum(at + 1, m)]), _NEVER)
                when[row, np.minimum(at, when.shape[1] - 1)] = after
                some = at > 0
                when[row[some], at[some] - 1] = self._time_of(token[row[some], at[some] - 1], token[row[some], at[some]])
            for i, t in zip(live.tolist(), done, strict=True):
                out[i] = t
        return out

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Pre-tokens, as printable characters, to ids as little-endian unsigned 32-bit integers."""
        flat, sizes = self.propose_together(units)
        owner = np.repeat(np.arange(len(units)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, np.int64)
        pair, back = np.unique(flat[inner] * self._size + flat[inner + 1], return_inverse=True)
        bad = ~self.compatible(pair // self._size, pair % self._size)[back]
        failed = np.unique(owner[inner[bad]]).tolist()
        self.proposed, self.failed = self.proposed + len(units), self.failed + len(failed)
        raw, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        found = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for i, ids in zip(failed, self.merge_together([units[i] for i in failed]), strict=True):
            found[i] = np.array(ids, "<u4").tobytes()
        return found

    def split_plain(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words at s to e: (their bytes without what is between them, where each atom starts there, the number of atoms of each word).
        An atom is a pre-token of a word of printable ASCII, in lower case, or a whole other word."""
        size = e - s
        at = np.cumsum(size) - size
        ink = buf[spread_rows(size, s)]
        low = _LOWER[ink]
        kind = self._kind[low]
        odd = np.repeat(np.minimum.reduceat(kind, at) == 0, size)
        new = (kind == 2) | np.append(True, kind[1:] != kind[:-1])
        new &= ~odd
        new[at] = True
        return np.where(odd, ink, low), np.flatnonzero(new), np.add.reduceat(new, at, dtype=np.int64)

    def _units(self, words: list[str]) -> list[list[str | int]]:
        """Pre-tokens of each word, as printable characters; a special token is its id."""
        parts: list[list[str | int]] = [[]]
        text = unicodedata.normalize("NFC", "".join([w + "\n" for w in words])).replace("Σ", "σ").lower()
        for u in self._split_lines.findall(text):
            if u == "\n":
                parts.append([])
            else:
                parts[-1].append(u.encode().decode("latin-1").translate(self._chars))
        return parts[:-1]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        texts, special = [w.decode() for w in words], self._special
        units = self._units(texts)
        for i, t in enumerate(texts):
            if special and special.search(t):
                units[i] = [u for part in special.split(t) if part for u in ([self.special[part]] if part in self.special else self._units([part])[0])]
        distinct = list(dict.fromkeys(u for x in units for u in x if isinstance(u, str)))
        ids = dict(zip(distinct, self.encode_units(distinct), strict=True))
        return [b"".join([ids[u] if isinstance(u, str) else u.to_bytes(4, "little") for u in x]) for x in units]

    def encode_atoms(self, atoms: list[bytes]) -> list[bytes]:
        """encode_words for what split_plain gives."""
        if not atoms:
            return []
        ends = np.cumsum(np.fromiter(map(len, atoms), np.int64, len(atoms)))
        kind = self._kind[np.frombuffer(b"".join(atoms), np.uint8)]
        plain = (np.minimum.reduceat(kind, np.append(0, ends[:-1])) > 0).tolist()
        units = iter(self.encode_units([x.decode() for x, p in zip(atoms, plain, strict=True) if p]))
        others = iter(self.encode_words([x for x, p in zip(atoms, plain, strict=True) if not p]))
        return [next(units if p else others) for p in plain]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Rows of tokens, ids[bounds[i]:bounds[i + 1]], joined by one space, as there is no decoder; UTF-8."""
        buf, off = utf8(self.names.take(pa.array(ids)))
        ends, raw = off[bounds], memoryview(np.ascontiguousarray(buf))
        return [bytes(raw[a : max(a, b - 1)]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class WordTable:
    """Texts to ids by a bounded table of atoms."""

    def __init__(self, model: WordBpe):
        self._model, self._table, self._again = model, {}, set()

    def _looked_up(self, distinct: list[bytes]) -> list[bytes]:
        if len(self._table) > TABLE_WORDS:
            kept = {w: self._table[w] for w in self._again}
            self._table, self._again = kept if 2 * len(kept) <= TABLE_WORDS else {}, set()
        table = self._table
        found = list(map(table.get, distinct))
        self._again.update(w for w, x in zip(distinct, found, strict=True) if x is not None)
        new = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(new, self._model.encode_atoms([distinct[i] for i in new]), strict=True):
            found[i] = x
            if len(distinct[i]) <= TABLE_BYTES_EACH:
                table[distinct[i]] = x
        return found

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows of UTF-8: their ids, one row after the other, and the rows' bounds."""
        s, e, row = words(buf, off)
        if not len(s):
            return np.zeros(0, "<u4"), np.zeros(len(off), np.int64)
        ink, at, atoms = self._model.split_plain(buf, s, e)
        coded = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(ink))), pa.py_buffer(ink)]).dictionary_encode()
        found = self._looked_up(coded.dictionary.to_pylist())
        own = coded.indices.to_numpy()
        tokens = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        many = tokens[own]
        ids = flat[spread_rows(many, (np.cumsum(tokens) - tokens)[own])]
        first = np.concatenate(([0], np.cumsum(atoms)))[np.searchsorted(row, np.arange(len(off)))]  # of each row
        return ids, np.concatenate(([0], np.cumsum(many)))[first]


@functools.lru_cache(1)
def _bpe(path: str) -> tuple[WordBpe, WordTable]:
    bpe = WordBpe(path)
    return bpe, WordTable(bpe)


def _encoded(path: str, digest: bool):
    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, table = _bpe(path)
        for batch in batches:
            for rows, buf, off in pieces(batch, "text", TABLE_BYTES):
                ids, bounds = table.encode(buf, off)
                raw, at = memoryview(ids.tobytes()), (4 * bounds).tolist()
                own = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                decoded = bpe.decode(ids, bounds)
                if digest:
                    out = [pa.array([hashlib.sha256(x).hexdigest() for x in some]) for some in (own, decoded)]
                else:
                    out = [pa.array([bytes(x) for x in own], pa.binary()), pa.array([x.decode() for x in decoded], pa.string())]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(bounds)), *out], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def bpe_round(docs: DataFrame, path: str | None = None, digest: bool = False) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and
    decoded text, or with `digest` the SHA-256 of both, so that the ids need not leave the task."""
    kinds = "ids string, decoded string" if digest else "ids binary, decoded string"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encoded(path or vocabulary_path(), digest), f"doc_id long, n_tokens long, {kinds}")


def query(spark, sf_dir):
    return bpe_round(load(spark, sf_dir, "documents"), digest=True).withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})
