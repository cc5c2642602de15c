"""A third of all rows on one key: same results as SQL, and no group of work holds the key."""

import duckdb
import pytest
from pyspark.sql import functions as F

from freshness.operators import joins as J, priority as R, windows as N
from freshness.operators.ordered import hour_slice, with_row_number

FOLDER = "/root/testdata/sf0.01"
HOT = "CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id + 1 END"


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("key", F.expr(HOT))


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT *, {HOT} AS key FROM '{FOLDER}/events.parquet'")
    return con


def same(df, con, sql):
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(sql).fetchall())


def test_the_hot_key_is_spread(events):
    total = events.count()
    keys = events.groupBy("key").count().agg(F.max("count")).first()[0]
    slices = events.groupBy("key", hour_slice("ts")).count().agg(F.max("count")).first()[0]
    assert keys > total / 3 - 1
    assert slices < total / 500


def test_no_window_is_partitioned_by_the_key_alone(events):
    placed = with_row_number(events.select("key", "ts", "event_id"), "key", ["ts", "event_id"], hour_slice("ts"))
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    wide = [line for line in plan.splitlines() if "Window [" in line and "event_id" in line]
    assert wide and all("_slice" in line for line in wide)


def test_asof(events, con):
    q = events.where("event_type = 'view'").select("event_id", "key", "ts")
    v = events.where("event_type = 'purchase'").select("key", "ts", F.col("event_id").alias("vid"), "value")
    out = J.asof_left(q, v, "key", "ts", "vid", ["vid", "value"]).select("event_id", F.coalesce("vid", F.lit(-1)))
    same(out, con, """SELECT q.event_id, coalesce(v.event_id, -1) FROM (SELECT * FROM events WHERE event_type = 'view') q
        ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') v ON q.key = v.key AND q.ts >= v.ts""")


def test_count_windows(events, con):
    out = N.count_windows(events, "key", ["ts", "event_id"], "event_id", 24, 8, hour_slice("ts"))
    out = out.select("key", "end_rn", F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x))
    same(out, con, """WITH r AS (SELECT key, row_number() OVER w AS rn, sum(event_id) OVER (w ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS s
        FROM events WINDOW w AS (PARTITION BY key ORDER BY ts, event_id))
        SELECT key, rn, CAST(s AS BIGINT) FROM r WHERE rn >= 24 AND (rn - 24) % 8 = 0""")


def test_rolling_and_gaps(events, con):
    rows = events.select("key", "ts", "event_id", "value")
    out = N.rolling(rows, "key", ["ts", "event_id"], "value", 50, "max", hour_slice("ts"), block_rows=128)
    out = out.select("event_id", F.coalesce("rolled", F.lit(-1.0)))
    same(out, con, """SELECT event_id, coalesce(CASE WHEN row_number() OVER w >= 50 THEN max(value) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) END, -1)
        FROM events WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)""")


def test_one_score_for_most_keys(events, con):
    counts = events.groupBy("event_id").agg((F.max("key") == 0).cast("int").alias("score"), F.lit(1).alias("pending"))
    out = R.rank_keys(counts, "event_id", F.col("score")).select("event_id", "rank")
    same(out, con, "SELECT event_id, row_number() OVER (ORDER BY CASE WHEN key = 0 THEN 1 ELSE 0 END DESC, event_id) FROM events")
