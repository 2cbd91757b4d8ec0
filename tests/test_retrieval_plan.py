from tessera.operators import retrieval


def test_a_pair_is_shuffled_once_not_for_each_term(spark):
    """Pairs meet postings by chunk alone: a join by chunk and term made a shuffled row of each term of each pair."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = spark.createDataFrame([(1, 7), (1, 8), (2, 7)], "q int, c int")
        asked = spark.createDataFrame([(1, "a", 0.6), (1, "b", 0.8), (2, "b", 1.0)], "q int, term string, qw double")
        postings = spark.createDataFrame([(7, "a", 0.6), (7, "b", 0.8), (8, "a", 1.0), (9, "a", 1.0)], "c int, term string, weight double")
        found = retrieval.similarities(pairs, asked.hint("broadcast"), postings)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(c#" in plan and ", term#" not in "".join(x for x in plan.split("\n") if "hashpartitioning" in x)
        assert sorted(tuple(r) for r in found.collect()) == [(1, 7, 1.0), (1, 8, 0.6), (2, 7, 0.8)]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
