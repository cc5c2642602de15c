from pyspark.sql import functions as F

from freshness.operators import joins as J
from freshness.operators.ordered import width_slice


def frames(spark):
    q = spark.createDataFrame([(1, 7, 5), (2, 7, 10), (3, 8, 3), (4, 9, 0), (5, 7, 100)], "qid LONG, key LONG, t LONG")
    f = spark.createDataFrame([(7, 5, 1, "a"), (7, 5, 2, "b"), (7, 90, 3, "c"), (9, 1, 4, "d")], "key LONG, t LONG, vid LONG, x STRING")
    return q, f


def as_map(df):
    return {r.qid: r.x for r in df.collect()}


def test_asof_edges(spark):
    q, f = frames(spark)
    for width in (1, 4, 1000):
        s = width_slice("t", width)
        assert as_map(J.asof_left(q, f, "key", "t", "vid", ["x"], s)) == {1: "b", 2: "b", 3: None, 4: None, 5: "c"}
        assert as_map(J.asof_strict(q, f, "key", "t", "vid", ["x"], s)) == {1: None, 2: "b", 3: None, 4: None, 5: "c"}
        assert as_map(J.asof_inner(q, f, "key", "t", "vid", ["x"], s)) == {1: "b", 2: "b", 5: "c"}
        init = spark.createDataFrame([(8, "i8"), (9, "i9")], "key LONG, x STRING")
        got = J.asof_with_default(q, f, init, "key", "t", "vid", ["x"], s)
        assert as_map(got) == {1: "b", 2: "b", 3: "i8", 4: "i9", 5: "c"}


def test_a_version_without_value_is_still_a_version(spark):
    q, f = frames(spark)
    f = f.withColumn("x", F.when(F.col("vid") != 3, F.col("x")))
    assert as_map(J.asof_left(q, f, "key", "t", "vid", ["x"], width_slice("t", 10)))[5] is None


def test_count_before(spark):
    q = spark.createDataFrame([(1, 7, 10), (2, 7, 3), (3, 8, 5)], "qid LONG, key LONG, t LONG")
    e = spark.createDataFrame([(7, 1), (7, 5), (7, 6), (7, 10), (7, 11)], "key LONG, t LONG")
    u = spark.createDataFrame([(7, 5), (7, 12)], "key LONG, t LONG")
    got = J.count_before(q, e, u, "key", "t", width_slice("t", 2)).collect()
    assert {r.qid: (r.past, r.pending) for r in got} == {1: (2, 2), 2: (0, 1), 3: (0, 0)}


def test_plan_slices_crosses_blocks(spark):
    rows = spark.range(1, 101).select(F.lit(1).alias("key"), F.col("id").alias("rn"))
    plan = spark.createDataFrame([(1, 5, 37), (1, 37, 37), (1, 90, 200), (2, 1, 9), (1, 9, 3)], "key INT, a LONG, b LONG")
    got = J.plan_slices(plan, rows, "key", "a", "b", "rn", block=8).groupBy("a").count().collect()
    assert {r.a: r["count"] for r in got} == {5: 33, 37: 1, 90: 11}


def test_time_spine_and_suffixes(spark):
    counts = spark.createDataFrame([(3, 2), (6, 1)], "step LONG, n LONG")
    assert sorted(map(tuple, J.time_spine(counts, "step", "n").collect())) == [(3, 2), (4, 0), (5, 0), (6, 1)]
    a = spark.createDataFrame([(1, 2.0)], "id LONG, v DOUBLE")
    assert J.join_predictions(a, a, "id").columns == ["id", "v_x", "v_y"]


def test_null_keys_match_nothing(spark):
    queries = spark.createDataFrame([(1, None, 100), (2, None, 90000), (3, 5, 90000)], "query_id long, k long, s long")
    versions = spark.createDataFrame([(10, None, 50), (11, 5, 60)], "version_id long, k long, s long")
    at = lambda df: df.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    found = J.asof_left(at(queries), at(versions), "k", "ts", "version_id", ["version_id"]).collect()
    assert {r.query_id: r.version_id for r in found} == {1: None, 2: None, 3: 11}


def test_a_refresh_without_passages_keeps_the_old_version(spark):
    at = lambda rows, schema: spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    questions = at([(1, 7, 100), (2, 8, 100)], "query_id long, doc_id long, s long")
    plan = at([(7, 20, 10), (7, 21, 50)], "doc_id long, revid long, s long")
    init = spark.createDataFrame([(7, 1), (8, 2)], "doc_id long, revid long")
    revisions = spark.createDataFrame([(20, ["a"])], "revid long, passages array<string>")
    found = {r.query_id: (r.revid, r.missing) for r in J.questions_on_docs(questions, plan, init, revisions).collect()}
    assert found == {1: (20, 0), 2: (2, 1)}
