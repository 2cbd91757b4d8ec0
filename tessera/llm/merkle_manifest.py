"""A Merkle manifest of a table: leaves, subtrees by language, one root, and a proof for every row.

H is lower-case hex SHA-256; digests enter it as hex text. A leaf is H of the row's fields, each `-` if null, else its UTF-8 byte count, `:` and
its value. A language's leaves ascend by doc_id; while there are several nodes, every ARITY consecutive ones become their H. The subroots, ordered by
language, become the root in the same way.

Leaves are made by Spark's own functions and leave their texts at once. Rows are sorted by ranges of the whole order and written; the number of
a row in its part and the counts of the parts before give its place. Blocks of ARITY**k places are reduced by tasks, a group each; k is the least
(3 or more) that leaves TOP blocks at most, so that what reaches the driver, 32 bytes a block, is bounded (one of 8**7 leaves, for 10**11 rows,
is 67 MB in a task). The driver builds the tree above the blocks and sends it to the tasks; each cuts its blocks' suffix paths
out of it (the paths themselves would repeat every node seven times a level), makes the block's own levels again, and folds
each row's path from its leaf to the root.

Cases: null texts and other null fields are `-`, empty ones `0:`. A null language is a language of its own, the first. Null doc_ids come first; rows of
one doc_id are ordered by leaf, and equal rows have proofs of their own. An empty table gives an empty result. Extra columns don't enter the leaves.
Languages are names: each is a node of the top tree and at most TOP of them are taken, else ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, load

#: Nodes that become one; levels of a block, at least; blocks, at most.
ARITY, LEVELS, TOP = 8, 3, 1 << 16
#: The fields of a leaf, in order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROW = "doc_id long, lang string, place long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def raised(nodes: list[str]) -> list[str]:
    """The next level of a tree."""
    return [sha256("".join(nodes[i : i + ARITY])) for i in range(0, len(nodes), ARITY)]


def tree(nodes: list[str]) -> list[list[str]]:
    """All levels, the last of one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append(raised(levels[-1]))
    return levels


def siblings(level: list[str], i: int) -> tuple[str, str]:
    """What stands before and after node i in its run."""
    first = i - i % ARITY
    return "".join(level[first:i]), "".join(level[i + 1 : first + ARITY])


def path(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """The siblings on the way from node i of the first level to below the last."""
    return [siblings(level, i // ARITY**j) for j, level in enumerate(levels[:-1])]


def folded(leaf: str, way: list[tuple[str, str]]) -> str:
    for before, after in way:
        leaf = sha256(before + leaf + after)
    return leaf


def height(n: int) -> int:
    """Levels above n leaves."""
    found = 0
    while n > 1:
        n, found = -(-n // ARITY), found + 1
    return found


def leaf_of(fields: dict[str, Column]) -> Column:
    """Its 32 bytes."""
    told = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields.values()]
    return F.unhex(F.sha2(F.concat(*told).cast("binary"), 256))


def _hex(column: pa.ChunkedArray) -> list[str | None]:
    return [None if x is None else x.hex() for x in column.to_pylist()]


def _reduced(levels: list[int]):
    """The leaves of one block to its node. levels: how many a block of each language has."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        g, block = (x.as_py() for x in key)
        nodes = _hex(table.sort_by("place").column("leaf"))
        for _ in range(levels[g]):
            nodes = raised(nodes)
        return pa.table({"g": pa.array([g], pa.int32()), "block": pa.array([block], pa.int64()), "node": pa.array([bytes.fromhex(nodes[0])])})

    return run


def _proved(names: list[str | None], levels: list[int], tops: list[list[list[str]]], above: list[list[str]]):
    """The rows of one block with their proofs. tops: the levels from each language's blocks to its subroot; above: from the subroots to the root."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        g, block = (x.as_py() for x in key)
        table = table.sort_by("place")
        leaves, other = _hex(table.column("leaf")), _hex(table.column("tampered"))
        own = [leaves]
        for _ in range(levels[g]):
            own.append(raised(own[-1]))
        suffix = path(tops[g], block) + path(above, g)
        ways = [[siblings(level, i) for i in range(len(level))] for level in own[:-1]]
        subroot, root = tops[g][-1][0], above[-1][0]
        proofs, roots = [], []
        for i, (leaf, changed) in enumerate(zip(leaves, other, strict=True)):
            way = [level[i // ARITY**j] for j, level in enumerate(ways)] + suffix
            proofs.append(sha256("".join(x + y for x, y in way)))
            roots.append(folded(changed or leaf, way))
        n = len(leaves)
        return pa.table({
            "doc_id": table.column("doc_id"), "lang": pa.array([names[g]] * n, pa.string()), "place": table.column("place"), "leaf": leaves,
            "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": roots, "verified": [r == root for r in roots],
        })

    return run


def _placed(rows: DataFrame) -> tuple[DataFrame, list[tuple[str | None, int]]]:
    """rows(lang, doc_id, leaf, ...) with g, the language's number, and place, the row's in its language; languages and their counts."""
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["lang", "doc_id", "leaf", "tie"]  # equal rows may be cut apart
    ranges = rows.withColumn("tie", F.rand(0)).repartitionByRange(tasks, *order).sortWithinPartitions(*order).drop("tie")
    # A row's number is its part's, then its own in the part: fixed once it is written.
    written = cut(ranges.withColumn("id", F.monotonically_increasing_id()), "leaves")
    part, own = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    parts = written.groupBy(part.alias("part"), "lang").agg(F.min(own).alias("first"), F.count("*").alias("n")).collect()  # parts + languages rows at most
    langs: dict[str | None, int] = {}
    shifts = []
    for r in sorted(parts, key=lambda r: ((r["lang"] is not None, (r["lang"] or "").encode()), r["part"])):
        before = langs.get(r["lang"], 0)
        shifts.append((r["part"], r["lang"], before - r["first"]))
        langs[r["lang"]] = before + r["n"]
    names = list(langs)
    number = {name: i for i, name in enumerate(names)}
    table = spark.createDataFrame([(p, name, number[name], shift) for p, name, shift in shifts], "part long, name string, g int, shift long")
    placed = written.join(F.broadcast(table), (part == F.col("part")) & F.col("lang").eqNullSafe(F.col("name")))
    return placed.withColumn("place", own + F.col("shift")).drop("part", "name", "shift", "id", "lang"), [(name, langs[name]) for name in names]


def merkle_manifest(docs: DataFrame, fields: list[str] = FIELDS, tamper: Callable[[dict[str, Column]], tuple[Column, dict[str, Column]]] | None = None) -> DataFrame:
    """Per row of docs: doc_id, lang, place, leaf, subroot, root, proof_sha256, folded_root and verified, which is whether the row's leaf, as it
    is found now, leads to the root. tamper(columns): which rows are found changed, and their columns then."""
    spark, columns = docs.sparkSession, {c: docs[f"`{c}`"] for c in fields}
    changed = F.lit(None).cast("binary")
    if tamper:
        which, instead = tamper(columns)
        changed = F.when(which, leaf_of(columns | instead))
    rows = docs.select(docs["lang"].cast("string").alias("lang"), docs["doc_id"].cast("long").alias("doc_id"), leaf_of(columns).alias("leaf"), changed.alias("tampered"))
    placed, langs = _placed(rows)
    if not langs:
        return spark.createDataFrame([], _ROW)
    if len(langs) > TOP:
        raise ValueError(f"{len(langs)} languages; each is a node of the top tree, which has {TOP} at most")
    k = LEVELS
    while sum(-(-n // ARITY**k) for _, n in langs if n > ARITY**k) > TOP:
        k += 1
    levels = [min(k, height(n)) for _, n in langs]
    blocks = placed.withColumn("block", F.expr(f"place div {ARITY**k}L"))
    found = blocks.select("g", "block", "place", "leaf").groupBy("g", "block").applyInArrow(_reduced(levels), "g int, block long, node binary")
    nodes: list[list[str]] = [[] for _ in langs]
    for r in sorted(found.collect(), key=lambda r: (r["g"], r["block"])):  # TOP blocks and a node for each language at most
        nodes[r["g"]].append(bytes(r["node"]).hex())
    tops = [tree(x) for x in nodes]
    above = tree([x[-1][0] for x in tops])
    return blocks.groupBy("g", "block").applyInArrow(_proved([name for name, _ in langs], levels, tops, above), _ROW)


def lowered(columns: dict[str, Column]) -> tuple[Column, dict[str, Column]]:
    """A third of the rows, by a checksum of doc_id, have A-Z of their text in lower case."""
    return F.crc32(columns["doc_id"].cast("string").cast("binary")) % 3 == 0, {"text": F.translate(columns["text"], _UPPER, _LOWER)}


def query(spark, sf_dir):
    found = merkle_manifest(load(spark, sf_dir, "documents"), tamper=lowered)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _sql(depth: int = 8, depth_above: int = 4) -> str:
    """DuckDB's form for languages of up to 8**depth rows, and up to 8**depth_above languages; a level is a table."""
    from tessera.llm.periodic_runs import crc32_sql

    told = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in FIELDS)
    run = "OVER (PARTITION BY {0}i // 8 ORDER BY i ROWS BETWEEN {1})"

    def level(name: str, j: int, group: str) -> str:
        up = f"SELECT {group}i // 8 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d, (any_value(n) + 7) // 8 AS n FROM {name}{j} WHERE n > 1 GROUP BY {group}i // 8"
        sides = [f"coalesce(string_agg(d, '') {run.format(group, rows)}, '') AS {x}" for x, rows in (("b", "UNBOUNDED PRECEDING AND 1 PRECEDING"), ("a", "1 FOLLOWING AND UNBOUNDED FOLLOWING"))]
        return f"{name}{j + 1} AS MATERIALIZED ({up}),\n {name}s{j} AS MATERIALIZED (SELECT {group}i, {', '.join(sides)} FROM {name}{j} WHERE n > 1)"

    parts = [f"""doc AS MATERIALIZED (SELECT *, sha256({told}) AS leaf, sha256({told.replace("text", f"translate(text, '{_UPPER}', '{_LOWER}')")}) AS other, {crc32_sql("doc_id::VARCHAR")} AS h FROM documents),
 leafs AS MATERIALIZED (SELECT doc_id, lang, leaf, CASE WHEN h % 3 = 0 THEN other ELSE leaf END AS found, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
  count(*) OVER (PARTITION BY lang) AS n FROM doc),
 l0 AS (SELECT lang, i, leaf AS d, n FROM leafs)"""]
    parts += [level("l", j, "lang, ") for j in range(depth)]
    parts.append("sub AS MATERIALIZED (SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM (" + " UNION ALL ".join(f"SELECT lang, d FROM l{j} WHERE n = 1" for j in range(depth + 1)) + "))")
    parts.append("u0 AS (SELECT i, subroot AS d, n FROM sub)")
    parts += [level("u", j, "") for j in range(depth_above)]
    parts.append("top AS (" + " UNION ALL ".join(f"SELECT d AS root FROM u{j} WHERE n = 1" for j in range(depth_above + 1)) + ")")
    parts.append("f0 AS (SELECT leafs.*, sub.subroot, sub.i AS u, found AS f, '' AS p FROM leafs JOIN sub ON leafs.lang IS NOT DISTINCT FROM sub.lang)")
    steps = [(f"ls{j}", f"x.lang IS NOT DISTINCT FROM y.lang AND y.i = x.i // {8**j}") for j in range(depth)] + [(f"us{j}", f"y.i = x.u // {8**j}") for j in range(depth_above)]
    for j, (table, on) in enumerate(steps):
        parts.append(f"f{j + 1} AS (SELECT x.* REPLACE (CASE WHEN y.i IS NULL THEN f ELSE sha256(b || f || a) END AS f, p || coalesce(b || a, '') AS p) FROM f{j} AS x LEFT JOIN {table} AS y ON {on})")
    return "WITH " + ",\n ".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{len(steps)}, top"


SQL = _sql()
