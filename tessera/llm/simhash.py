"""SimHash near-duplicates with deletion-variant signatures.

A fingerprint is cut into two segments of 32 bits. If two fingerprints differ in at most two bits, one
segment differs in at most one, so the two agree in one of its 32 variants with one bit left out. The
64 variants of each distinct fingerprint are the index; equal variants meet and are verified by counting
bits. Copies are one fingerprint, whatever their number. Variants that more than BUCKET fingerprints
share would give a square of pairs: there the 64 bits are one segment, of which two bits are left out (2016 variants of a
fingerprint), and members need no pairs, only a link to the smallest. No link is lost either way. (Cutting a crowded key further
by its other 33 bits costs 33, then 17, 9, ... variants for each of up to 64 crowded keys of a fingerprint, which in a dense group, where no
cut thins the keys out, is more than 2016.)

One or two bits are much tighter than near copies are. With `similarity`, texts whose sets of five-word shingles have at least
that Jaccard similarity are linked too (near.py), whatever their fingerprints; the pipeline's stage asks for it, the query doesn't.

Cases: null and empty texts have fingerprint zero, linked like any other. A null doc_id gets a
fingerprint and a component, and never names one unless all members' ids are null (then it is null).
Repeated doc_ids keep a row each. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import near
from tessera.llm.common import cut, load, trimmed, widened
from tessera.llm.components import components

SHINGLE = 3
DISTANCE = 2
#: The most fingerprints of a variant that are compared pair by pair.
BUCKET = 48


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    w = text.encode().lower().split() if text else ()
    if not w:
        return 0
    joined, n = b" ".join(w), max(1, len(w) - shingle + 1)
    size = np.fromiter(map(len, w), np.int64, len(w))
    end = np.cumsum(size + 1) - 1
    digest = xxhash.xxh64_intdigest
    starts, ends = (end - size)[:n].tolist(), end[len(w) - n :].tolist()
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], np.uint64)
    ones = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _fingerprints(shingle: int, sketch: bool = False):
    """sketch: with the node and bands of the text."""

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in near.sketched(batches) if sketch else batches:
            fp = [fingerprint(x.as_py(), shingle) for x in batch.column("text")]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(fp, pa.int64())], [*names, "fp"])

    return run


def links(fps: DataFrame) -> DataFrame:
    """fps(fp), distinct: edges (u, v) that join all fingerprints with at most two differing bits."""
    j = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("j")
    key = F.expr("(cast(j as bigint) << 32) | (shiftrightunsigned(fp, 32 * (j div 32)) & 4294967295L & ~shiftleft(1L, j % 32))")
    index = widened(fps).select("fp", j).select("fp", key.alias("key"))
    buckets = cut(index.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1"), "buckets")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE
    pairs = buckets.where("n = 2").select("u", "v").where(near).distinct()
    if not buckets.where("n > 2").limit(1).count():
        return pairs
    # Sizes are guessed without the 64 rows that a fingerprint becomes: by them the index would be broadcast through the driver.
    crowded = cut(index.hint("merge").join(buckets.where("n > 2").select("key", "n"), "key"), "crowded")
    small = crowded.where(F.col("n") <= BUCKET)
    more = small.select("key", F.col("fp").alias("u")).join(small.select("key", F.col("fp").alias("v")), "key").where("u < v").where(near).select("u", "v").distinct()
    two = F.explode(F.expr("flatten(transform(sequence(1, 63), a -> transform(sequence(0, a - 1), b -> shiftleft(1L, a) | shiftleft(1L, b))))")).alias("out")
    wide = widened(crowded.where(F.col("n") > BUCKET).select("fp").distinct()).select("fp", two).select("fp", "out", F.expr("fp & ~out").alias("rest"))
    stars = wide.groupBy("out", "rest").agg(F.count("*").alias("n"), F.min("fp").alias("v"), F.collect_set("fp").alias("all")).where("n > 1")
    return pairs.union(more).union(stars.select(F.explode("all").alias("u"), "v").where("u <> v").distinct())


def _linked(rows: DataFrame, shingle: int, similarity: float | None = None) -> DataFrame:
    """rows(text, doc_id, ...) to the other columns, fp, root (the component's smallest fingerprint) and component_id."""
    sketch = similarity is not None
    texts = rows.select("text")
    kinds = ", ".join(f"{name} {kind}" for name, kind in rows.drop("text").dtypes)
    rows = cut(rows.mapInArrow(_fingerprints(shingle, sketch), f"{kinds}, {'node long, bands array<long>, ' * sketch}fp long"), "fingerprints")
    own = rows.groupBy("fp").agg(F.min("doc_id").alias("lo"))
    edges = links(own.select("fp"))
    if sketch:
        edges = edges.union(near.links(rows, texts, similarity))
        rows = rows.drop("node", "bands")
    roots = components(edges)
    named = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "lo", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("lo").alias("component_id"))
    named = cut(named.join(least, "root").select("fp", "root", "component_id"), "components")
    return rows.join(named, "fp")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, fp (a long), component_id, the smallest doc_id that links reach."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _linked(rows, shingle).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The rows of docs, all columns, that stay: of each component the smallest doc_id (null comes last, then by a
    hash of the text), as one row. similarity: links texts that are so alike as well."""
    key = F.xxhash64("doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key.alias("key"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    stay = _linked(rows, shingle, similarity).groupBy("root").agg(F.min(order).alias("m")).select(F.col("m.key").alias("stay"))
    keyed = docs.select(key.alias("stay"), F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns)).alias("row")).join(stay, "stay")
    return keyed.dropDuplicates(["stay"]).select("row.*")


def query(spark, sf_dir):
    found = simhash_components(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
