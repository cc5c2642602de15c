"""Section 2.4: aggregates."""

from datetime import timedelta

from pyspark.sql import functions as F

from freshness.operators import aggs as A, joins as J
from freshness.operators.ordered import day_slice, hour_slice, width_slice
from freshness.plans.prep import HOURS, hours
from freshness.plans.registry import query
from freshness.plans.tables import PREDICTIONS, RATING_ORDER, RATINGS, RATING_ORDER_SQL, VERSIONS, VIEWS

STALENESS = f"""{VIEWS}, {VERSIONS}, served AS (
  SELECT query_id, q.user_id, q.ts, q.y AS y_true, v.feature AS y_pred, v.ts AS feature_ts, version_id,
         date_diff('hour', TIMESTAMP '1970-01-01', q.ts) - date_diff('hour', TIMESTAMP '1970-01-01', v.ts) AS staleness
  FROM views q ASOF LEFT JOIN versions v ON q.user_id = v.user_id AND q.ts >= v.ts)"""


def served(t):
    """View queries with the purchase value in force as their prediction."""
    out = J.asof_left(t.views, t.versions, "user_id", "ts", "version_id", ["feature", "version_id"])
    return out.select(
        "query_id", "user_id", "ts", F.col("y").alias("y_true"), F.col("feature").alias("y_pred"), "feature_ts",
        "version_id", (hour_slice("ts") - hour_slice("feature_ts")).alias("staleness"),
    )


@query("busy_keys", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 65")
def _(t):
    return A.busy_keys(t.events, "user_id", 65)


@query("past_updates", f"WITH {RATINGS} SELECT user_id, count(*) AS past_updates FROM ratings GROUP BY user_id")
def _(t):
    return A.past_updates(t.ratings, "user_id")


@query("arrival_rate", f"WITH {HOURS} SELECT hr, count(DISTINCT key) AS keys, count(*) AS n FROM hours GROUP BY hr")
def _(t):
    return A.arrival_rate(hours(t), "hr", "key").select("hr", "keys", "n")


@query("arrival_rate_approximate")
def _(t):
    return A.arrival_rate(hours(t), "hr", "key", approximate=True)


@query("key_span", """SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts,
  round(date_diff('microsecond', min(ts), max(ts)) / 1000000, 6) AS length FROM events GROUP BY user_id""")
def _(t):
    return A.key_span(t.events, "user_id", "ts").withColumn("length", F.round("length", 6))


@query("rating_pivot", f"""WITH {RATINGS} SELECT user_id, """ + ", ".join(
    f"round(coalesce(avg(rating) FILTER (l_linenumber = {i}), 0), 4) AS line_{i}" for i in range(1, 8)
) + " FROM ratings GROUP BY user_id")
def _(t):
    out = A.rating_pivot(t.ratings, "user_id", "l_linenumber", "rating", list(range(1, 8)))
    return out.select("user_id", *[F.round(F.col(f"{i}"), 4).alias(f"line_{i}") for i in range(1, 8)])


POLICIES = ["click", "error", "purchase", "signup"]


@query("update_heatmap", "SELECT user_id AS key, " + ", ".join(
    f"count(*) FILTER (event_type = '{p}') AS {p}" for p in POLICIES
) + " FROM events WHERE event_type <> 'view' GROUP BY user_id")
def _(t):
    return A.update_heatmap(t.updates, "key", POLICIES)


@query("update_counts", """SELECT user_id AS key, event_type AS policy, CAST(ts AS DATE) AS day, count(*) AS n_updates
FROM events WHERE event_type <> 'view' GROUP BY ALL""")
def _(t):
    return A.update_counts(t.updates, ["key", "policy", F.to_date("time").alias("day")])


LOG = """log AS (
  SELECT epoch(ts) AS ingest_time, epoch(ts) + value / 100 AS processing_time, value / 1000 AS runtime
  FROM events WHERE event_type = 'purchase')"""


def update_log(t):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t.events.where("event_type = 'purchase'").select(
        seconds.alias("ingest_time"), (seconds + F.col("value") / 100).alias("processing_time"),
        (F.col("value") / 1000).alias("runtime"),
    )


@query("throughput_summary", f"""WITH {LOG}, m AS (
  SELECT count(*) AS n_updates, max(ingest_time) - min(ingest_time) AS ingest_span,
         max(processing_time) - min(ingest_time) AS total_time, avg(runtime) AS mean_runtime FROM log)
SELECT n_updates, round(ingest_span, 2) AS ingest_span, round(total_time, 2) AS total_time,
  round(mean_runtime, 4) AS mean_runtime, round(n_updates / total_time, 6) AS rate,
  round(mean_runtime * n_updates / 4, 4) AS expected_runtime FROM m""")
def _(t):
    out = A.throughput_summary(update_log(t), 4)
    digits = {"ingest_span": 2, "total_time": 2, "mean_runtime": 4, "rate": 6, "expected_runtime": 4}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("latency", f"""WITH {LOG}, w AS (SELECT processing_time - ingest_time AS wait FROM log)
SELECT round(min(wait), 5) AS min_latency, round(avg(wait), 5) AS mean_latency, round(median(wait), 5) AS median_latency FROM w""")
def _(t):
    out = A.latency(update_log(t))
    return out.select(*[F.round(c, 5).alias(c) for c in ("min_latency", "mean_latency", "median_latency")])


@query("error_by_group", f"""WITH {PREDICTIONS}
SELECT policy, year(ts)::INTEGER AS year, round(avg(power(y_pred - y_true, 2)), 4) AS mse,
       round(avg(abs(y_pred - y_true)), 4) AS mae, count(*) AS n
FROM predictions GROUP BY ALL""")
def _(t):
    out = A.error_by_group(t.predictions.withColumn("year", F.year("ts")), ["policy", "year"])
    return out.withColumn("mse", F.round("mse", 4)).withColumn("mae", F.round("mae", 4))


@query("error_vs_factor", f"""WITH {STALENESS}, e AS (
  SELECT staleness // 24 AS age_days, abs(y_pred - y_true) AS error FROM served WHERE y_pred IS NOT NULL)
SELECT age_days, round(avg(error), 9) AS mean_error, count(*) AS n, round(median(error), 9) AS median_error,
       round(ln(avg(error)), 9) AS log_mean, round(CASE WHEN median(error) <> 0 THEN ln(median(error)) END, 9) AS log_median
FROM e GROUP BY age_days""")
def _(t):
    e = served(t).where("y_pred IS NOT NULL").select(
        F.floor(F.col("staleness") / 24).cast("long").alias("age_days"), F.abs(F.col("y_pred") - F.col("y_true")).alias("error")
    )
    out = A.error_vs_factor(e, "age_days", "error", width_slice("error", 1))
    return out.select("age_days", "n", *[F.round(c, 9).alias(c) for c in ("mean_error", "median_error", "log_mean", "log_median")])


@query("hourly_error", f"""WITH {STALENESS}
SELECT date_diff('minute', TIMESTAMP '2024-01-01', ts) // 60 AS bucket, staleness >= 24 AS stale,
       round(sum(abs(y_pred - y_true)), 4) AS abs_error
FROM served WHERE y_pred IS NOT NULL GROUP BY ALL""")
def _(t):
    start = day_slice(F.lit("2024-01-01").cast("timestamp_ntz")) * 1440
    minute = hour_slice("ts") * 60 + F.minute("ts") - start
    p = served(t).where("y_pred IS NOT NULL").withColumn("minute", minute).withColumn("stale", F.col("staleness") >= 24)
    return A.hourly_error(p, "minute", 60, "stale").withColumn("abs_error", F.round("abs_error", 4))


@query("cross_key_mse", f"""WITH {STALENESS}
SELECT CAST(ts AS DATE) AS day, round(sum(power(y_pred - y_true, 2)) / nullif(count(*) FILTER (power(y_pred - y_true, 2) <> 0), 0), 9) AS mse
FROM served GROUP BY 1""")
def _(t):
    out = A.cross_key_mse(served(t).withColumn("day", F.to_date("ts")), "day")
    return out.withColumn("mse", F.round("mse", 9))


@query("loss_describe", f"""WITH {PREDICTIONS}, per_user AS (
  SELECT user_id, policy, avg(power(y_pred - y_true, 2)) AS loss, count(DISTINCT ts) // 10 AS n_fits
  FROM predictions GROUP BY ALL)
SELECT n_fits, count(loss) AS n, round(avg(loss), 4) AS mean, round(stddev(loss), 4) AS std, round(min(loss), 4) AS min,
  round(max(loss), 4) AS max, round(quantile_cont(loss, 0.25), 4) AS q25, round(quantile_cont(loss, 0.5), 4) AS q50,
  round(quantile_cont(loss, 0.75), 4) AS q75
FROM per_user GROUP BY n_fits""")
def _(t):
    sq = F.pow(F.col("y_pred") - F.col("y_true"), 2)
    per_day = t.predictions.groupBy("user_id", "policy", "ts").agg(F.sum(sq).alias("s"), F.count(sq).alias("c"))
    per_user = per_day.groupBy("user_id", "policy").agg(
        (F.sum("s") / F.sum("c")).alias("loss"), F.floor(F.count("ts") / 10).cast("long").alias("n_fits")
    )
    out = A.loss_describe(per_user, "n_fits", "loss", width_slice("loss", 0.001))
    return out.select("n_fits", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max", "q25", "q50", "q75")])


@query("distinct_versions", f"""WITH {STALENESS} SELECT user_id, count(DISTINCT version_id) AS n_versions FROM served GROUP BY user_id""")
def _(t):
    return A.distinct_versions(served(t), "user_id", "version_id")


@query("fold_step_events", f"""WITH {RATINGS}
SELECT user_id, ts, CAST(0 AS BIGINT) AS chunk, CAST(count(*) AS INTEGER) AS n, string_agg(item_id, ',' ORDER BY {RATING_ORDER_SQL}) AS items
FROM ratings GROUP BY user_id, ts""")
def _(t):
    out = A.fold_step_events(t.ratings, "user_id", "ts", "item_id", "rating", RATING_ORDER, width_slice("l_orderkey", 65_536))
    return out.select("user_id", "ts", "chunk", F.size("items").alias("n"), F.array_join("items", ",").alias("items"))


@query("minute_streams", """WITH e AS (
  SELECT event_id, user_id AS doc_id, date_diff('hour', TIMESTAMP '1970-01-01', ts) AS ts_hour, ts FROM events),
first AS (SELECT doc_id, arg_min(event_id, (ts, event_id)) AS init_edit FROM e GROUP BY doc_id)
SELECT ts_hour, e.doc_id, CAST(0 AS BIGINT) AS chunk, string_agg(event_id, ',' ORDER BY event_id) AS edits, any_value(init_edit) AS init_edit
FROM e JOIN first USING (doc_id) GROUP BY ALL""")
def _(t):
    edits = t.events.select("event_id", F.col("user_id").alias("doc_id"), hour_slice("ts").alias("ts_hour"), "ts")
    lists = A.minute_streams(edits, "doc_id", "ts_hour", "event_id", width_slice("event_id", 65_536))
    out = lists.join(A.first_edits(edits, "doc_id", ["ts", "event_id"], "event_id"), "doc_id")
    return out.withColumn("edits", F.array_join("edits", ","))


@query("weighted_avg", """SELECT event_type, round(sum(value * k) / nullif(sum(k), 0), 4) AS weighted_avg
FROM (SELECT event_type, value, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k FROM events) GROUP BY event_type""")
def _(t):
    weighted = t.events.select("event_type", "value", F.regexp_extract("props", "[0-9]+", 0).cast("double").alias("k"))
    return A.weighted_mean_by(weighted, "event_type", "value", "k").withColumn("weighted_avg", F.round("weighted_avg", 4))


@query("view_shares", """SELECT user_id, count(*) AS n_views, round(count(*) / (SELECT count(*) FROM events WHERE event_type = 'view'), 6) AS share
FROM events WHERE event_type = 'view' GROUP BY user_id""")
def _(t):
    daily = t.views.groupBy("user_id", day_slice("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return A.view_shares(daily, "user_id", "n").withColumn("share", F.round("share", 6))


EPOCH_DAY = "2023-12-31"


def view_days(t):
    """Names of the days from the first view to the last, also those without a view."""
    day, epoch = F.to_date("ts"), F.lit(EPOCH_DAY).cast("date")
    first, last = t.views.agg(F.coalesce(F.min(day), epoch), F.coalesce(F.max(day), epoch)).first()
    return [f"{first + timedelta(days=i):%Y%m%d}00" for i in range((last - first).days + 1)]


def views_wide(t, days):
    """Views of each user, one column per day."""
    day = F.date_format("ts", "yyyyMMdd'00'")
    return t.views.withColumn("day", day).groupBy("user_id").pivot("day", days).agg(F.count(F.lit(1))).fillna(0)


@query("views_long", """WITH v AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY ALL),
span AS (SELECT min(day) AS first, max(day) AS last FROM v),
d AS (SELECT first + CAST(i AS INTEGER) AS day FROM (SELECT first, unnest(range(0, last - first + 1)) AS i FROM span)), u AS (SELECT DISTINCT user_id FROM v)
SELECT u.user_id, d.day, coalesce(v.n, 0) AS n_views, (d.day - DATE '2023-12-31') * 1440 AS ts_min
FROM u CROSS JOIN d LEFT JOIN v ON v.user_id = u.user_id AND v.day = d.day""")
def _(t):
    days = view_days(t)
    return A.views_long(views_wide(t, days), "user_id", days, EPOCH_DAY)


@query("weight_buckets", """WITH w AS (SELECT user_id, greatest(count(*) // 10, 1) AS w FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN w <= 1 THEN 1 WHEN w <= 2 THEN 2 WHEN w <= 5 THEN 5 WHEN w <= 6 THEN 6 ELSE 7 END::BIGINT AS bucket FROM w""")
def _(t):
    counts = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("weight"))
    return counts.select("user_id", A.weight_bucket("weight", [1, 2, 5, 6, 7]).alias("bucket"))


@query("edit_query_counts", """SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n_edits,
  count(*) FILTER (event_type = 'view') AS n_queries FROM events WHERE event_type IN ('purchase', 'view') GROUP BY user_id""")
def _(t):
    return A.edit_query_counts(t.versions, t.views, "user_id")


@query("coverage_report", f"""WITH {HOURS}, p AS (SELECT DISTINCT key, hr FROM hours),
k AS (SELECT key, count(*) AS n, min(hr) AS f FROM p GROUP BY key)
SELECT 'keys_per_time' AS report, n AS bin, count(*) AS times FROM (SELECT hr, count(*) AS n FROM p GROUP BY hr) GROUP BY n
UNION ALL SELECT 'times_per_key', n, count(*) FROM k GROUP BY n
UNION ALL SELECT 'first_times', f, count(*) FROM k GROUP BY f""")
def _(t):
    return A.coverage_report(hours(t), "key", "hr")


@query("new_key_stats", f"""WITH {RATINGS}, fresh AS (
  SELECT user_id, count(*) AS n FROM ratings WHERE ts >= TIMESTAMP '1995-02-01'
    AND user_id NOT IN (SELECT user_id FROM ratings WHERE ts < TIMESTAMP '1995-02-01') GROUP BY user_id)
SELECT count(*) AS n_new_keys, round(avg(n), 4) AS mean_rows FROM fresh""")
def _(t):
    train = t.ratings.where("ts < TIMESTAMP_NTZ '1995-02-01'")
    stream = t.ratings.where("ts >= TIMESTAMP_NTZ '1995-02-01'")
    return A.new_key_stats(train, stream, "user_id").withColumn("mean_rows", F.round("mean_rows", 4))
