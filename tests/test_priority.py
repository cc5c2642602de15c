import itertools
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from freshness.operators import allocation as A, priority as R
from freshness.operators.ordered import width_slice
from freshness.plans import catalog


def inputs(spark, rows):
    return spark.createDataFrame(rows, "key LONG, pending LONG, error_since DOUBLE, queries_since LONG, past_updates LONG")


def test_ties_go_to_the_lowest_key_and_idle_keys_drop_out(spark):
    table = inputs(spark, [(3, 1, 5.0, 1, 0), (1, 1, 5.0, 1, 2), (2, 0, 9.0, 1, 1), (4, 2, 1.0, 7, 0)])
    rank = lambda score: [r.key for r in R.rank_keys(table, "key", score).orderBy("rank").collect()]
    assert rank(R.total_error()) == [1, 3, 4]
    assert rank(R.total_error_cold()) == [3, 4, 1]
    assert rank(R.max_pending()) == [4, 1, 3]
    assert rank(R.min_past()) == [3, 4, 1]
    assert rank(R.query_proportional()) == [4, 1, 3]
    assert rank(R.query_proportional_cold()) == [3, 4, 1]
    assert R.rank_keys(table.where("false"), "key", R.total_error()).count() == 0


@pytest.mark.parametrize("budget", [0.0, 0.5, 1.0, 2.5, 50.0])
def test_budget_carries_fractions_and_is_never_exceeded(spark, budget):
    scored = spark.range(1, 11).select(F.col("id").alias("round"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("key"))
    taken = R.take_budget_rounds(scored.withColumn("score", F.col("key") % 3), "key", "round", budget)
    counts = {r["round"]: r["n"] for r in taken.groupBy("round").agg(F.count(F.lit(1)).alias("n")).collect()}
    for r in range(1, 11):
        assert counts.get(r, 0) == min(6, int(np.floor(r * budget) - np.floor((r - 1) * budget)))


def test_batch_equals_the_loop(spark):
    rng = np.random.default_rng(2)
    arrivals = rng.integers(0, 9, 60)
    rows = [(i + 1, int(n)) for i, n in enumerate(arrivals)]
    table = spark.createDataFrame(rows, "round LONG, n LONG")
    got = {r["round"]: r.refreshed for r in R.batch_when_affordable(table, "round", "n", 3.7, width_slice("round", 7)).collect()}
    budget, waiting, want = 0.0, 0, {}
    for r, n in rows:
        budget += 3.7
        waiting += n
        if budget >= waiting:
            want[r] = waiting
            budget -= waiting
            waiting = 0
    assert got == want


def test_allocation_is_the_cheapest(spark):
    losses = {1: [9.0, 4.0, 2.0, 1.5], 2: [5.0, 3.0, 2.5, 2.4], 3: [1.0, 0.9, 0.85, 0.84]}
    rows = [(k, i, v) for k, vs in losses.items() for i, v in enumerate(vs)]
    table = spark.createDataFrame(rows, "key LONG, fits INT, loss DOUBLE")
    for cap in range(0, 8):
        got = {r.key: r.n_fits for r in R.allocate_fits(table, "key", "fits", "loss", cap).collect()}
        best = min(
            sum(losses[k][n] for k, n in zip(losses, combo))
            for combo in itertools.product(range(4), repeat=3) if sum(combo) <= cap
        )
        assert sum(got.values()) <= cap
        assert sum(losses[k][n] for k, n in got.items()) == pytest.approx(best)


@pytest.mark.parametrize("fan", [2, 32])
def test_allocation_over_any_curve_equals_enumeration(spark, fan):
    rng = np.random.default_rng(5)
    losses = {k: {i: float(rng.uniform(0, 9)) for i in range(k % 2, 5) if i == k % 2 or rng.random() < 0.8} for k in range(1, 7)}
    losses[7] = {0: 8.0, 1: 8.0, 2: 8.0, 3: 0.5}  # nothing saved before the third fit
    rows = [(k, i, v) for k, curve in losses.items() for i, v in curve.items()]
    odd = [(1, 1, 99.0), (None, 0, 0.0), (2, None, 0.0), (2, 4, None), (3, 3, float("nan"))]
    table = spark.createDataFrame(rows + odd, "key LONG, fits LONG, loss DOUBLE")
    choices = [list(losses[k].items()) for k in sorted(losses)]
    base = sum(min(c) for c in losses.values())
    reached = {}
    for combo in itertools.product(*choices):
        extra = sum(i for i, _ in combo) - base
        reached[extra] = min(reached.get(extra, np.inf), sum(v for _, v in combo))
    for cap in (0, 2, 3, 7, 100):
        got = {r.key: r.n_fits for r in A.allocate_fits_any(table, "key", "fits", "loss", cap, fan).collect()}
        assert set(got) == set(losses) and sum(got.values()) - base <= cap
        assert sum(losses[k][n] for k, n in got.items()) == pytest.approx(min(v for x, v in reached.items() if x <= cap))


def test_allocation_without_rows_and_with_ties(spark):
    table = spark.createDataFrame([(k, i, 4.0 - 2 * i) for k in (5, 3, 9) for i in (0, 1)], "key LONG, fits LONG, loss DOUBLE")
    assert A.allocate_fits_any(table.where("false"), "key", "fits", "loss", 3).count() == 0
    got = {r.key: r.n_fits for r in A.allocate_fits_any(table, "key", "fits", "loss", 2).collect()}
    assert got == {3: 1, 5: 1, 9: 0}


def test_inputs_split_at_the_last_update(spark):
    ev = spark.createDataFrame([(1, 1), (1, 5), (1, 9), (2, 3)], "key LONG, t LONG")
    up = spark.createDataFrame([(1, 2), (1, 5)], "key LONG, t LONG")
    pr = spark.createDataFrame([(1, 4, 1.0), (1, 6, 2.0), (1, 8, 0.5), (3, 1, 7.0)], "key LONG, t LONG, error DOUBLE")
    for width in (1, 3, 100):
        got = {r.key: r for r in R.priority_inputs(ev, up, pr, "key", "t", width_slice("t", width)).collect()}
        assert (got[1].pending, got[1].error_since, got[1].queries_since, got[1].past_updates) == (1, 2.5, 2, 2)
        assert (got[2].pending, got[2].last_update, got[2].past_updates) == (1, None, 0)
        assert (got[3].pending, got[3].error_since) == (0, 7.0)


def test_shedding(spark):
    rows = spark.range(0, 20).select((F.col("id") % 2).alias("key"), F.col("id").alias("t"))
    kept = R.shed_oldest(rows.where("key = 0 OR t < 6"), "key", "t", 6, width_slice("t", 3)).collect()
    assert sorted(r.t for r in kept if r.key == 0) == [14, 16, 18]
    assert sorted(r.t for r in kept if r.key == 1) == [1, 3, 5]


def test_forecast_error_counts_every_reading_and_every_key(spark, tmp_path):
    rng = np.random.default_rng(4)
    sizes, start = {1: 700, 2: 60, 3: 20, 4: 41, 5: 40}, datetime(2024, 1, 1)
    rows = [(k, start + timedelta(minutes=i), float(rng.normal(25, 9))) for k, n in sizes.items() for i in range(n)]
    rows = [(i, k, ts, value, "view") for i, (k, ts, value) in enumerate(rows)]
    schema = "event_id LONG, user_id LONG, ts TIMESTAMP_NTZ, value DOUBLE, event_type STRING"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    want = duckdb.sql(f"""WITH i AS (
      SELECT user_id AS key, value, row_number() OVER w AS rn, lag(value) OVER w AS prev FROM '{tmp_path}/events.parquet/*.parquet'
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    e AS (
      SELECT key, count(*) FILTER (base IS NULL OR rn > 40) AS pending, CASE WHEN any_value(base) IS NULL THEN 1000000 ELSE
        round(sum(abs(value - (base + 0.1::DOUBLE * (rn - 40)))) FILTER (rn > 40) / avg(abs(value - prev)) FILTER (rn <= 40), 6) END AS error
      FROM i LEFT JOIN (SELECT key, value AS base FROM i WHERE rn = 40) USING (key) GROUP BY key)
    SELECT key, error, greatest(key % 40 + 2.5, error) FROM e WHERE pending > 0""").fetchall()
    assert {k for k, *_ in want} == {1, 2, 3, 4}
    for at, name in ((1, "rank_forecast_error"), (2, "rank_forecast_error_epsilon")):
        got = {r.key: (r.score, r["rank"]) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
        by_score = sorted(want, key=lambda r: (-r[at], r[0]))
        assert {k: r for k, (_, r) in got.items()} == {r[0]: i + 1 for i, r in enumerate(by_score)}
        assert all(got[r[0]][0] == pytest.approx(r[at], abs=1e-5) for r in want)
