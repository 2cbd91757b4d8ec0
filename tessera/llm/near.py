"""Pairs of texts whose sets of shingles are alike, by bands of least hashes and exact checks of the whole sets.

A text's set holds the hashes of its lower-cased runs of SHINGLE words (of all its words if it has fewer). BANDS x ROWS
least hashes are cut into bands; texts that agree in a whole band are candidates, and candidates are linked if the Jaccard
similarity of their whole sets reaches the bound. A pair of similarity s shares a band with probability
1 - (1 - s**ROWS)**BANDS: 0.9996 at 0.8. Copies (equal words in lower case) are one node, whatever their number.

What is asked for is the components of the links, so in a band that more than BUCKET nodes share not every pair becomes a row, though none
that could join two components is left out:
1. Each node goes to one block of the largest such band it is in; a block (BLOCK nodes or BLOCK_SHINGLES hashes, about) finds all
   links between its nodes by products of 0/1 matrices, and returns a spanning forest and how many links each node has.
2. In each band all nodes that its block didn't join with it are compared with the node of most links: the text that the rest was
   made from, if there is one.
3. In bands that then hold several components, blocks are paired: those of the component of that node with those of the other nodes, and the latter among
   themselves. All pairs of two components are decided there; nodes of one component aren't compared.
Third steps take as long as a band has nodes that nothing links, squared, in blocks; nothing is skipped for that.

Cases: texts without words have no set and no candidates.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, RangeHash, as_long, cut, in_table, marked, mix, pieces, released, trimmed, word_hashes, words
from tessera.llm.components import components

SHINGLE = 5
BANDS, ROWS = 20, 5
#: The most nodes of a band whose pairs are rows; nodes of a block and hashes in their sets, about.
BUCKET, BLOCK, BLOCK_SHINGLES = 48, 256, 1 << 17
#: Columns of a matrix, and how many nodes of a block must share a hash to be a column (others are counted pair by pair).
COLUMNS, DENSE = 2048, 16
#: Pairs of owners of such hashes that are counted at a time.
PAIRS = 1 << 17

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEEDS = np.random.default_rng(5).integers(0, 1 << 64, (3, BANDS * ROWS), np.uint64) | U64(1)


def shingles(buf: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of shingles, their bounds by row, a hash of each row's words)."""
    buf = _LOWER[buf]
    s, e, row = words(buf, off)
    count = np.bincount(row, minlength=len(off) - 1)
    h = RangeHash(word_hashes(buf, s, e))
    first = np.concatenate(([0], np.cumsum(count)))
    many = np.where(count, np.maximum(count - size + 1, 1), 0)
    bounds = np.concatenate(([0], np.cumsum(many)))
    start = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first[:-1], many)
    return h(start, np.minimum(start + size, np.repeat(first[1:], many))), bounds, h(first[:-1], first[1:])


def bands(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each row that has shingles."""
    start = bounds[:-1][bounds[1:] > bounds[:-1]]
    keys = np.zeros((len(start), BANDS), U64)
    if len(start):
        for j in range(BANDS * ROWS):
            least = np.minimum.reduceat((h ^ _SEEDS[0, j]) * _SEEDS[1, j], start)
            keys[:, j // ROWS] += least * _SEEDS[2, j]
    return mix(keys)


def sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with a column text get node (a hash of the words) and bands."""
    for batch in batches:
        for rows, buf, off in pieces(batch, "text"):
            h, bounds, node = shingles(buf, off)
            some = bounds[1:] > bounds[:-1]
            offsets = np.concatenate(([0], np.cumsum(np.where(some, BANDS, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), as_long(bands(h, bounds).ravel()))
            yield pa.RecordBatch.from_arrays([*rows.columns, as_long(node), lists], [*rows.schema.names, "node", "bands"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two sets (sorted, distinct) share."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    out = np.zeros((n, n), np.float32)
    first = np.cumsum(count) - count
    for c in range(2, DENSE + 1):  # hashes of c nodes: the pairs of their owners
        start, (a, b) = first[count == c], np.triu_indices(c, 1)
        for i in range(0, len(start), max(1, PAIRS // len(a))):
            some = owner[start[i : i + max(1, PAIRS // len(a))][:, None] + np.arange(c)]
            out += np.bincount((some[:, a] * n + some[:, b]).ravel(), minlength=n * n).reshape(n, n)
    out += out.T
    many = count > DENSE
    column = np.cumsum(many) - 1
    token, owner = token[many[token]], owner[many[token]]
    column = column[token]
    for lo in range(0, int(many.sum()), COLUMNS):
        own = slice(*np.searchsorted(column, (lo, lo + COLUMNS)))
        held = np.zeros((n, COLUMNS), np.float32)
        held[owner[own], column[own] - lo] = 1
        out += held @ held.T
    np.fill_diagonal(out, size)
    return out


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node's parent in a spanning forest of a matrix of links, -1 for a root, and its root."""
    n = len(linked)
    parent, top, new = np.full(n, -1), np.arange(n), np.ones(n, bool)
    for root in range(n):
        todo = [root] if new[root] else []
        new[root] = False
        while todo:
            at = todo.pop()
            found = np.flatnonzero(linked[at] & new)
            parent[found], top[found], new[found] = at, root, False
            todo += found.tolist()
    return parent, top


def _blocks(similarity: float):
    """A group's rows (node, label, side, shingles) to (node, parent, root, degree): all links between nodes of two labels and, if
    the group has two, of two sides."""

    def run(_: tuple, table: pa.Table) -> pa.Table:
        node, label, side = (table.column(c).to_numpy() for c in ("node", "label", "side"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        both, size = overlaps(sets), np.array([len(x) for x in sets], np.float32)
        linked = both >= similarity * (size[:, None] + size - both) - 1e-4
        linked &= label[:, None] != label
        if side.min() != side.max():
            linked &= side[:, None] != side
        parent, top = _forest(linked)
        up = pa.array(node[np.maximum(parent, 0)], mask=parent < 0)
        released()
        return pa.table({"node": pa.array(node), "parent": up, "root": pa.array(node[top]), "degree": pa.array(linked.sum(1).astype(np.int64))})

    return run


def _alike(similarity: float, rows: int = 256):
    """Batches of (u, v, s, t), s and t the sets, to those (u, v) that are alike."""

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                keep = []
                for s, t in zip(part.column("s"), part.column("t"), strict=True):
                    a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (s, t))
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(both >= similarity * (len(a) + len(b) - both) - 1e-4)
                yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _node_sets(table: np.ndarray):
    """Batches of (text) to (node, shingles) of nodes in the table, each node once a task."""

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had: set[int] = set()
        for batch in batches:
            for _, buf, off in pieces(batch, "text"):
                h, bounds, node = shingles(buf, off)
                nodes, sets = [], []
                for i in np.flatnonzero(in_table(table, node.view(np.int64)) & (bounds[1:] > bounds[:-1])).tolist():
                    if int(node[i]) not in had:
                        had.add(int(node[i]))
                        nodes.append(node[i])
                        sets.append(np.unique(h[bounds[i] : bounds[i + 1]]).tobytes())
                yield pa.RecordBatch.from_arrays([as_long(np.array(nodes, U64)), pa.array(sets, pa.binary())], ["node", "shingles"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """pairs(u, v) whose sets are alike. Sizes decide first; only hashes of what is left travel."""
    near = F.col("m") >= F.lit(similarity) * F.col("n") - 1e-4
    near &= F.col("n") >= F.lit(similarity) * F.col("m") - 1e-4
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("s"), F.length("shingles").alias("m"))
    sizes = sets.select(F.col("node").alias("v"), F.length("shingles").alias("n"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("t"))
    likely = pairs.join(sizes, "v").join(left, "u").where(near).select("u", "v", "s")
    return likely.join(right, "v").select("u", "v", "s", "t").mapInArrow(_alike(similarity), "u long, v long")


def _labelled(crowded: DataFrame, edges: DataFrame) -> DataFrame:
    """crowded with label, the component of the edges that the node is in."""
    roots = components(edges)
    return crowded.join(roots.select("node", "root"), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")


def crowded_links(crowded: DataFrame, sets: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """crowded(key, node, n), bands of many nodes, and the edges (u, v) that are known: edges that, with these, have the components of all links."""
    held = sets.select("node", "shingles", (F.length("shingles") / 8).alias("size"))
    crowded = cut(crowded.join(held.select("node", "size"), "node"), "members")
    sizes = crowded.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("size") / BLOCK_SHINGLES)).cast("int")
    kinds = "node long, parent long, root long, degree long"
    one = crowded.groupBy("node").agg(F.max(F.struct("n", "key")).alias("m")).select("node", F.col("m.key").alias("key"))
    one = one.join(sizes.select("key", blocks.alias("blocks")), "key").select("key", "node", F.pmod(F.xxhash64("node"), "blocks").alias("block"))
    found = one.join(held, "node").select("key", "block", "node", F.col("node").alias("label"), F.lit(0).alias("side"), "shingles")
    found = cut(found.groupBy("key", "block").applyInArrow(_blocks(similarity), kinds), "blocks")
    edges = found.where("parent is not null").select(F.col("node").alias("u"), F.col("parent").alias("v"))

    def still_open() -> DataFrame:
        """The members of bands of several components; best: the node of most links, and its component."""
        several = _labelled(crowded, known.union(edges)).join(found.select("node", "degree"), "node")
        best = several.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.max(F.struct("degree", "node", "label")).alias("best")).where("a <> b")
        return cut(several.join(best.select("key", "best"), "key"), "open")

    placed = cut(crowded.join(found.select("node", "root", "degree"), "node"), "placed")
    best = placed.groupBy("key").agg(F.max(F.struct("degree", "node", "root")).alias("best"))
    pairs = placed.join(best, "key").where("root <> best.root").select(F.col("node").alias("u"), F.col("best.node").alias("v")).distinct()
    edges = cut(edges.union(_verified(pairs, sets, similarity)), "edges")
    rest = still_open()
    if not rest.limit(1).count():
        return edges
    # Blocks of the main component (side 0) and of the others (side 1), and the pairs of blocks each node goes to.
    rest = rest.withColumn("side", (F.col("label") != F.col("best.label")).cast("int"))
    shares = rest.groupBy("key").agg(*(F.greatest(F.lit(1), F.ceil(F.greatest(F.count_if(F.col("side") == s) / BLOCK, F.sum(F.when(F.col("side") == s, F.col("size"))) / BLOCK_SHINGLES))).cast("int").alias(f"blocks{s}") for s in (0, 1)))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, F.col("blocks0")).otherwise(F.col("blocks1"))).cast("int")
    rest = rest.join(shares, "key").withColumn("own", own)
    across = F.expr("transform(sequence(0, if(side = 0, blocks1, blocks0) - 1), j -> struct(0 as kind, if(side = 0, own, j) as a, if(side = 0, j, own) as b))")
    inner = F.expr("if(side = 0, array(), transform(sequence(0, blocks1 - 1), j -> struct(1 as kind, least(own, j) as a, greatest(own, j) as b)))")
    dealt = rest.select("key", "node", "label", "side", F.explode(F.concat(across, inner)).alias("at")).select("key", "at.*", "node", "label", "side")
    # Sizes are guessed without the rows that a node becomes: by them these would be broadcast through the driver.
    more = dealt.hint("merge").join(held.select("node", "shingles"), "node").groupBy("key", "kind", "a", "b").applyInArrow(_blocks(similarity), kinds)
    return edges.union(more.where("parent is not null").select(F.col("node").alias("u"), F.col("parent").alias("v")))


def links(rows: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """rows(node, bands, fp), fp the same in all rows of a node, of texts(text): edges (u, v) of fps with the components of alike texts."""
    # Copies become one row before anything is joined by node or key.
    nodes = cut(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    index = nodes.select(F.explode(F.array_distinct("bands")).alias("key"), "node")
    buckets = cut(index.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("u"), F.max("node").alias("v")).where("n > 1"), "buckets")
    shared = cut(index.join(buckets.where("n > 2").select("key", "n"), "key"), "shared")
    small = shared.where(F.col("n") <= BUCKET)
    pairs = small.select("key", F.col("node").alias("u")).join(small.select("key", F.col("node").alias("v")), "key").where("u < v").select("u", "v")
    pairs = cut(pairs.union(buckets.where("n = 2").select("u", "v")).distinct(), "candidates")
    crowded = shared.where(F.col("n") > BUCKET)
    ends = cut(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).union(crowded.select("node")).distinct(), "ends")
    held = texts.mapInArrow(_node_sets(marked(ends, "node")), "node long, shingles binary")
    sets = cut(held.join(ends, "node").groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    found = cut(_verified(pairs, sets, similarity), "alike")
    if crowded.limit(1).count():
        found = cut(found.union(crowded_links(crowded, sets, found, similarity)), "alike")
    left, right = nodes.select(F.col("node").alias("u"), F.col("fp").alias("f")), nodes.select(F.col("node").alias("v"), F.col("fp").alias("g"))
    return found.join(left, "u").join(right, "v").where("f <> g").select(F.col("f").alias("u"), F.col("g").alias("v")).distinct()
