"""TF-IDF retrieval in long form, by an impact-ordered index in blocks that are skipped by upper bounds.

A term's postings (chunk, weight) are cut by weight into LEVELS and, by a hash of the chunk, into blocks of about BLOCK; a block
is one row with its largest weight. No term's postings are sorted, ranked or joined one by one, however common it is.

A query is answered in two steps. First the best blocks of its few strongest terms name some chunks; the best of their exact similarities is
the query's running best. Then each of its terms gets a cut, below which postings aren't read: what they could add, the cuts times the
query's weights, is at most SHARE of the running best. That budget is spent where it saves most: raising a term's
cut over a level costs the query's weight times the level's width and saves the postings of the level, so levels are taken by postings saved for
their cost (common terms' low weights come first). The second step reads the blocks above the cuts and adds, for each chunk there, by how much
its weights exceed them: only a chunk for which this and the whole budget reach the running best can be the answer, and gets an exact
similarity. The answers are those of all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.stage import staged

#: Runs of two or more word characters, lower case.
TERM = r"(?U)\b\w\w+\b"


#: Weights of a level of a term, postings of a block (about), terms of a query whose best blocks give its first running best.
LEVELS, BLOCK, STRONG = 256, 64, 3
#: Of the running best, what postings that aren't read may come to.
SHARE = 0.5


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    terms = F.regexp_extract_all(F.lower(F.col(text)), F.lit(TERM), F.lit(0))
    return df.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def inverse_frequency(counts: DataFrame, documents: DataFrame) -> DataFrame:
    """ln((1 + n) / (1 + df)) + 1, with n counted from the documents, those without a term included."""
    n = documents.agg(F.count("*").alias("n"))
    return counts.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("term", (F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1).alias("idf"))


def weights(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """tf * idf, each row's vector of length 1; terms without idf fall away."""
    raw = counts.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.withColumn("norm", norm).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


class BlockIndex:
    """chunks(chunk_id, text) by term: counts, inverse frequencies and the lengths of the chunks' vectors, staged."""

    def __init__(self, chunks: DataFrame, chunk_id: str, chunk_text: str = "text"):
        self.chunks = chunks.select(F.col(chunk_id).alias("c"), F.col(chunk_text).alias("t"))
        # Dealt by chunk while they are texts: the terms are then counted without another shuffle, and each written part has whole chunks, so that their lengths are sums within parts.
        self.counts = staged(term_counts(self.chunks.repartition("c"), "c", "t"), "terms")
        self.idf = staged(inverse_frequency(self.counts, self.chunks), "idf")
        w = F.col("tf") * F.col("idf")
        self.norms = staged(self.counts.join(self.idf, "term").groupBy("c").agg(F.sqrt(F.sum(w * w)).alias("norm")), "norms")

    def postings(self, terms: DataFrame) -> DataFrame:
        """(c, term, weight) of the terms(term), distinct."""
        own = self.counts.join(terms, "term", "left_semi").join(self.idf, "term").join(self.norms, "c")
        return own.select("c", "term", (F.col("tf") * F.col("idf") / F.col("norm")).alias("weight"))


def blocks_of(postings: DataFrame) -> DataFrame:
    """term, level, part, most (the block's largest weight), held (its postings)."""
    own = postings.select("term", F.floor(F.col("weight") * LEVELS).cast("int").alias("level"), "c", "weight")
    sizes = own.groupBy("term", "level").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    part = F.pmod(F.xxhash64("c"), F.col("blocks")).alias("part")
    cut = own.join(sizes, ["term", "level"]).select("term", "level", part, "c", "weight")
    return cut.groupBy("term", "level", "part").agg(F.max("weight").alias("most"), F.collect_list(F.struct("c", "weight")).alias("held"))


def similarities(pairs: DataFrame, asked: DataFrame, postings: DataFrame) -> DataFrame:
    """(q, c, similarity) of pairs(q, c), distinct: sums over the terms that both have. Pairs and postings meet by chunk, and the terms of
    the (few) queries come after, so that a pair is shuffled once, not once for each term, and sums need no other shuffle. Sums in another order differ in the last bits; rounding keeps ties ties."""
    both = pairs.join(postings, "c").join(asked.select("q", "term", "qw"), ["q", "term"])
    return both.groupBy("q", "c").agg(F.round(F.sum(F.col("weight") * F.col("qw")), 9).alias("similarity"))


def cuts(asked: DataFrame, blocks: DataFrame, postings: DataFrame) -> DataFrame:
    """Of each query and term of asked(q, term, qw): cut, the largest weight that isn't read (null: all are), above, the first level that is read
    (null: none is), and reach, what a chunk's excess over the cuts must come to."""
    best = blocks.groupBy("term").agg(F.max(F.struct("most", "level", "part")).alias("best"))
    strong = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.col("qw") * F.col("best.most")), "term"))
    first = asked.join(best, "term").withColumn("place", strong).where(F.col("place") <= STRONG).select("q", "term", "best.level", "best.part")
    named = first.join(blocks, ["term", "level", "part"]).select("q", F.explode("held.c").alias("c")).distinct()
    running = similarities(named, asked, postings).groupBy("q").agg(F.max("similarity").alias("running"))
    # A step of a term: from below one of its levels to above it; its worth never rises with the level, so lower steps come first.
    levels = blocks.groupBy("term", "level").agg(F.sum(F.size("held")).alias("saved"), F.max("most").alias("most"))
    below = F.coalesce(F.lag("most").over(Window.partitionBy("term").orderBy("level")), F.lit(0.0))
    levels = levels.withColumn("width", F.col("most") - below)
    worth = F.min(F.col("saved") / F.greatest("width", F.lit(1e-12))).over(Window.partitionBy("term").orderBy("level"))
    steps = asked.join(levels.withColumn("worth", worth), "term").withColumn("cost", F.col("qw") * F.col("width"))
    order = Window.partitionBy("q").orderBy(F.desc(F.col("worth") / F.col("qw")), "term", "level").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.join(running, "q").withColumn("spent", F.sum("cost").over(order))
    read = F.col("spent") > SHARE * F.col("running")
    found = steps.groupBy("q", "term", "qw").agg(F.max(F.when(~read, F.col("most"))).alias("cut"), F.min(F.when(read, F.col("level"))).alias("above"), F.max("running").alias("running"))
    # Chunks that tie with the running best are answers too.
    reach = F.col("running") - 1e-8 - F.sum(F.col("qw") * F.coalesce("cut", F.lit(0.0))).over(Window.partitionBy("q"))
    return found.withColumn("reach", reach).where("above is not null")


def candidates(asked: DataFrame, blocks: DataFrame, postings: DataFrame) -> DataFrame:
    """(q, c): the chunks that can be a query's answer, from the postings that it reads."""
    read = blocks.join(cuts(asked, blocks, postings), "term").where(F.col("level") >= F.col("above"))
    read = read.select("q", "reach", "qw", F.coalesce("cut", F.lit(0.0)).alias("cut"), F.explode("held").alias("p"))
    excess = F.sum(F.col("qw") * (F.col("p.weight") - F.col("cut")))
    return read.groupBy("q", F.col("p.c").alias("c")).agg(excess.alias("excess"), F.first("reach").alias("reach")).where(F.col("excess") >= F.col("reach")).select("q", "c")


def top1(queries: DataFrame, chunks: DataFrame, query_id: str, chunk_id: str, query_text: str = "text", chunk_text: str = "text") -> DataFrame:
    """Per query: the chunk of highest cosine similarity, the first on ties; similarity 0 with the first chunk if no
    term is shared."""
    index = BlockIndex(chunks, chunk_id, chunk_text)
    q = queries.select(F.col(query_id).alias("q"), F.col(query_text).alias("t"))
    asked = staged(weights(term_counts(q, "q", "t"), index.idf, "q").withColumnRenamed("weight", "qw"), "queries")
    postings = staged(index.postings(asked.select("term").distinct()), "postings")
    blocks = staged(blocks_of(postings), "blocks")
    likely = similarities(candidates(asked, blocks, postings), asked, postings)
    best = likely.groupBy("q").agg(F.max(F.struct("similarity", (-F.col("c")).alias("back"))).alias("m"))
    first = index.chunks.agg(F.min("c").alias("first"))
    out = q.select("q").join(best, "q", "left").join(F.broadcast(first))
    return out.select(F.col("q").alias(query_id), F.coalesce(-F.col("m.back"), F.col("first")).alias(chunk_id), F.coalesce("m.similarity", F.lit(0.0)).alias("similarity"))


def ranked(sims: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key in an order, by a window."""
    return sims.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("rank = 1").drop("rank")
