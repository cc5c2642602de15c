"""Section 2.2: projections, filters, re-basing, splits."""

from pyspark.sql import functions as F

from freshness.functions.scalars import clip, minute_index
from freshness.operators import prep as P
from freshness.operators.ordered import day_slice, hour_slice, width_slice
from freshness.plans.registry import query
from freshness.plans.tables import RATING_ORDER, RATING_ORDER_SQL, RATINGS, READINGS

ORDER = ["ts", "event_id"]


def hours(t):
    """Events with the whole hours since 1970."""
    return t.events.select("event_id", F.col("user_id").alias("key"), hour_slice("ts").alias("hr"), "value")


HOURS = """hours AS (
  SELECT event_id, user_id AS key, date_diff('hour', TIMESTAMP '1970-01-01', ts) AS hr, value FROM events)"""


@query("time_bucket", f"""WITH {HOURS}
SELECT event_id, hr, CAST(floor((hr - (SELECT min(hr) FROM hours)) / 6) AS BIGINT) AS bucket FROM hours""")
def _(t):
    return P.time_bucket(hours(t), "hr", 6).select("event_id", "hr", "bucket")


@query("rebase_per_key", f"""WITH {HOURS}
SELECT event_id, key, hr, round((hr - min(hr) OVER (PARTITION BY key)) / 100, 4) AS rebased FROM hours""")
def _(t):
    out = P.rebase_per_key(hours(t), "key", "hr", 100, width_slice("hr", 24))
    return out.select("event_id", "key", "hr", F.round("rebased", 4).alias("rebased"))


@query("squash_rows", f"""WITH {RATINGS}
SELECT user_id, item_id, l_orderkey, l_linenumber, l_suppkey, l_extendedprice,
       CAST((row_number() OVER (ORDER BY {RATING_ORDER_SQL}) - 1) // 100 AS BIGINT) AS step FROM ratings""")
def _(t):
    out = P.squash_rows(t.ratings, RATING_ORDER, 100, day_slice("ts"))
    return out.select("user_id", "item_id", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "step")


@query("minute_index", """SELECT event_id,
  CASE WHEN ts >= TIMESTAMP '2024-01-10' THEN CAST(floor(date_diff('microsecond', TIMESTAMP '2024-01-10', ts) / 60000000) AS BIGINT) END AS minute
FROM events""")
def _(t):
    return t.events.select("event_id", minute_index("ts", "2024-01-10 00:00:00").alias("minute"))


@query("assign_query_time", f"""WITH {HOURS} SELECT event_id, round(hr * 0.3::DOUBLE + 1000, 4) AS query_time FROM hours""")
def _(t):
    out = P.assign_query_time(hours(t), "hr", 1000.0, 0.3)
    return out.select("event_id", F.round("query_time", 4).alias("query_time"))


@query("clip", """SELECT event_id, round(least(greatest(value / 20, 1.0), 5.0), 4) AS clipped FROM events""")
def _(t):
    return t.events.select("event_id", F.round(clip(F.col("value") / 20, 1.0, 5.0), 4).alias("clipped"))


@query("zscore_filter", """WITH m AS (SELECT avg(value) AS a, stddev_pop(value) AS s FROM events)
SELECT event_id, value FROM events, m WHERE abs((value - a) / s) < 1.5""")
def _(t):
    return P.zscore_filter(t.events.select("event_id", "value"), "value", 1.5)


@query("complete_keys", f"""WITH {READINGS}
SELECT * FROM readings WHERE key IN (SELECT key FROM readings GROUP BY key HAVING count(*) >= 70)""")
def _(t):
    return P.complete_keys(t.readings, "key", 70)


@query("complete_keys_at_maximum", f"""WITH {READINGS}, n AS (SELECT key, count(*) AS n FROM readings GROUP BY key)
SELECT * FROM readings WHERE key IN (SELECT key FROM n WHERE n = (SELECT max(n) FROM n))""")
def _(t):
    return P.complete_keys(t.readings, "key")


@query("aligned_keys", """WITH days AS (SELECT event_id, user_id AS key, CAST(ts AS DATE) AS day FROM events)
SELECT * FROM days WHERE key IN (
  SELECT key FROM days GROUP BY key HAVING min(day) = DATE '2024-01-01' AND count(*) >= 65)""")
def _(t):
    days = t.events.select("event_id", F.col("user_id").alias("key"), F.to_date("ts").alias("day"))
    return P.aligned_keys(days, "key", "day", F.lit("2024-01-01").cast("date"), 65)


@query("prefix_rows", """WITH head AS (
  SELECT * FROM events WHERE event_type = 'view' ORDER BY ts, event_id LIMIT 1000)
SELECT 'result' AS kind, event_id, ts FROM head
UNION ALL
SELECT 'update', event_id, ts FROM events WHERE event_type = 'purchase' AND ts < (SELECT max(ts) FROM head)""")
def _(t):
    views = t.events.where("event_type = 'view'").select("event_id", "ts")
    purchases = t.events.where("event_type = 'purchase'").select("event_id", "ts")
    head, updates = P.prefix_rows(views, purchases, ORDER, "ts", 1000, hour_slice("ts"))
    return head.select(F.lit("result").alias("kind"), "*").unionByName(updates.select(F.lit("update").alias("kind"), "*"))


@query("skip_warmup", f"""WITH {READINGS}
SELECT * FROM readings QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts, event_id) > 20""")
def _(t):
    return P.skip_warmup(t.readings, "key", ORDER, 20, hour_slice("ts"))


@query("burst_rows", f"""WITH {HOURS}
SELECT event_id, hr FROM hours WHERE hr IN (SELECT hr FROM hours GROUP BY hr HAVING count(*) > 15)""")
def _(t):
    return P.burst_rows(hours(t).select("event_id", "hr"), "hr", 15)


@query("split_seen", """SELECT event_id, user_id,
  user_id IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-02') AS seen
FROM events WHERE ts >= TIMESTAMP '2024-01-02'""")
def _(t):
    train = t.events.where("ts < TIMESTAMP_NTZ '2024-01-02'")
    stream = t.events.where("ts >= TIMESTAMP_NTZ '2024-01-02'").select("event_id", "user_id")
    seen, unseen = P.split_seen(stream, train, "user_id")
    return seen.withColumn("seen", F.lit(True)).unionByName(unseen.withColumn("seen", F.lit(False)))


@query("implicit_label", f"""WITH {RATINGS}
SELECT user_id, item_id, l_orderkey, l_linenumber, CASE WHEN rating > 3 THEN 1 ELSE 0 END AS label FROM ratings""")
def _(t):
    return t.ratings.select("user_id", "item_id", "l_orderkey", "l_linenumber", P.implicit_label("rating").alias("label"))


@query("drop_incomplete", """SELECT event_id, prediction, oracle FROM (
  SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS prediction,
         CASE WHEN value > 10 THEN value * 2 END AS oracle FROM events)
WHERE prediction IS NOT NULL AND oracle IS NOT NULL""")
def _(t):
    made = t.events.select(
        "event_id",
        F.when(F.col("event_type") != "error", F.col("value")).alias("prediction"),
        F.when(F.col("value") > 10, F.col("value") * 2).alias("oracle"),
    )
    return P.drop_incomplete(made, ["prediction", "oracle"])


@query("map_labels", """SELECT event_id, event_type,
  CASE event_type WHEN 'view' THEN 'Query' WHEN 'purchase' THEN 'Refresh' ELSE event_type END AS label FROM events""")
def _(t):
    return P.map_labels(t.events.select("event_id", "event_type"), "event_type", {"view": "Query", "purchase": "Refresh"})


def rating_days(t):
    return t.ratings.select("user_id", "item_id", "l_orderkey", "l_linenumber", day_slice("ts").alias("day"))


RATING_DAYS = f"""{RATINGS}, rd AS (
  SELECT user_id, item_id, l_orderkey, l_linenumber, date_diff('day', TIMESTAMP '1970-01-01', ts) AS day FROM ratings)"""


@query("quantile_split", f"""WITH {RATING_DAYS}
SELECT *, CASE WHEN day <= (SELECT quantile_cont(day, 0.8) FROM rd) THEN 'train' ELSE 'stream' END AS part FROM rd""")
def _(t):
    train, stream = P.quantile_split(rating_days(t), "day", 0.8, F.col("day"))
    return train.withColumn("part", F.lit("train")).unionByName(stream.withColumn("part", F.lit("stream")))


@query("median_split", f"""WITH {RATING_DAYS}, m AS (SELECT median(day) AS m FROM rd)
SELECT rd.*, CASE WHEN day < m THEN 'train' ELSE 'stream' END AS part FROM rd, m WHERE day <> m""")
def _(t):
    train, stream = P.median_split(rating_days(t), "day", F.col("day"))
    return train.withColumn("part", F.lit("train")).unionByName(stream.withColumn("part", F.lit("stream")))


@query("per_key_half_split", f"""WITH {RATINGS}
SELECT user_id, item_id, ts, l_orderkey, l_linenumber, l_suppkey,
  CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY {RATING_ORDER_SQL}) - 1 < count(*) OVER (PARTITION BY user_id) / 2
       THEN 'train' ELSE 'stream' END AS part
FROM ratings""")
def _(t):
    out = P.per_key_half_split(t.ratings, "user_id", RATING_ORDER, day_slice("ts"))
    return out.select("user_id", "item_id", "ts", "l_orderkey", "l_linenumber", "l_suppkey", "part")


@query("sample_keys")
def _(t):
    return P.sample_keys(t.readings, "key", 20, 7)


@query("dense_ids", """SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS idx FROM (SELECT DISTINCT user_id FROM events)""")
def _(t):
    return P.dense_ids(t.events, "user_id", width=65_536)


@query("dense_ids_of_text", """SELECT url, row_number() OVER (ORDER BY url) - 1 AS idx FROM (SELECT DISTINCT url FROM pages)""")
def _(t):
    return P.dense_ids(t.read("pages"), "url")


@query("train_test_rows")
def _(t):
    train, test = P.train_test_rows(t.readings, 0.8, 3, ["event_id"])
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
