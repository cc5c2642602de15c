"""Sections 2.5 and 2.6: windows, top-k, set operations."""

from pyspark.sql import functions as F

from freshness.operators import windows as N
from freshness.operators.ordered import hour_slice, width_slice
from freshness.plans.aggs import POLICIES, STALENESS, served
from freshness.operators.aggs import update_heatmap
from freshness.plans.joins import INDEXED, indexed
from freshness.plans.registry import query
from freshness.plans.tables import ARRIVALS, READINGS, UPDATES, VERSIONS

ORDER = ["ts", "event_id"]


def windows24(t, size=24, slide=8):
    return N.count_windows(t.readings, "key", ORDER, "value", size, slide, hour_slice("ts"))


WINDOWS = f"""{INDEXED}, wins AS (
  SELECT key, rn AS end_rn, (rn - 24) // 8 AS "window",
         list(value) OVER (PARTITION BY key ORDER BY rn ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS vals,
         ts AS last_ts
  FROM indexed QUALIFY rn >= 24 AND (rn - 24) % 8 = 0)"""


@query("count_windows", f"""WITH {WINDOWS}
SELECT key, "window", end_rn, last_ts, round(vals[1], 4) AS first_value, round(vals[24], 4) AS last_value, round(list_sum(vals), 4) AS total FROM wins""")
def _(t):
    out = windows24(t)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return out.select(
        "key", "window", "end_rn", F.col("last_order.ts").alias("last_ts"), F.round(F.get("values", F.lit(0)), 4).alias("first_value"),
        F.round(F.element_at("values", -1), 4).alias("last_value"), F.round(total, 4).alias("total"),
    )


@query("count_windows_per_key", f"""WITH {INDEXED}, sl AS (SELECT DISTINCT key, 4 + key % 5 AS slide FROM readings)
SELECT i.key, (rn - 24) // slide AS "window", rn AS end_rn,
  round((SELECT sum(value) FROM indexed j WHERE j.key = i.key AND j.rn BETWEEN i.rn - 23 AND i.rn), 4) AS total
FROM indexed i JOIN sl ON i.key = sl.key WHERE rn >= 24 AND (rn - 24) % slide = 0""")
def _(t):
    slides = t.readings.select("key").distinct().withColumn("slide", 4 + F.col("key") % 5)
    out = N.count_windows_per_key(t.readings, "key", ORDER, "value", 24, slides, hour_slice("ts"))
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return out.select("key", "window", "end_rn", F.round(total, 4).alias("total"))


@query("rolling", f"""WITH {READINGS}
SELECT event_id, key, round(CASE WHEN row_number() OVER w >= 12 THEN avg(value) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) END, 4) AS rolled
FROM readings WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)""")
def _(t):
    out = N.rolling(t.readings, "key", ORDER, "value", 12, "avg", hour_slice("ts"))
    return out.select("event_id", "key", F.round("rolled", 4).alias("rolled"))


@query("rolling_arrivals", f"""WITH {ARRIVALS}
SELECT step, n, CASE WHEN row_number() OVER w >= 24 THEN CAST(max(n) OVER (w ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS BIGINT) END AS busiest
FROM arrivals WINDOW w AS (ORDER BY step)""")
def _(t):
    out = N.rolling(t.arrivals, None, "step", "n", 24, "max", width_slice("step", 1000), "busiest")
    return out.select("step", "n", "busiest")


@query("inter_arrival", """WITH e AS (SELECT event_id, user_id AS key, epoch_us(ts) AS us FROM events)
SELECT event_id, key, us - lag(us) OVER (PARTITION BY key ORDER BY us, event_id) AS gap,
  round((max(us) OVER (PARTITION BY key) - min(us) OVER (PARTITION BY key)) / nullif(count(*) OVER (PARTITION BY key) - 1, 0), 2) AS mean_gap
FROM e""")
def _(t):
    e = t.readings.select("event_id", "key", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    out = N.inter_arrival(e, "key", "us", ["us", "event_id"], hour_slice("ts"))
    return out.select("event_id", "key", "gap", F.round("mean_gap", 2).alias("mean_gap"))


@query("redraw_arrivals")
def _(t):
    e = t.readings.select("event_id", "key", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("sec"))
    return N.redraw_arrivals(e, "sec", ORDER, ["event_id"], "exponential", 11, hour_slice("ts"))


@query("staleness", f"""WITH {STALENESS}
SELECT query_id, user_id, round(date_diff('microsecond', feature_ts, ts) / 1000000, 6) AS staleness FROM served""")
def _(t):
    return served(t).select("query_id", "user_id", F.round(N.staleness("ts", "feature_ts"), 6).alias("staleness"))


@query("pending_and_past", f"""WITH {VERSIONS}, clicks AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'),
l AS (SELECT c.event_id, c.user_id, c.ts, v.ts AS u_ts FROM clicks c ASOF LEFT JOIN versions v ON c.user_id = v.user_id AND c.ts >= v.ts)
SELECT l.event_id, l.user_id, count(*) FILTER (o.ts <= u_ts) AS past, count(*) FILTER (u_ts IS NULL OR o.ts > u_ts) AS pending
FROM l JOIN clicks o ON o.user_id = l.user_id AND o.ts <= l.ts GROUP BY ALL""")
def _(t):
    clicks = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    out = N.pending_and_past(clicks, t.versions.select("user_id", "ts"), "user_id", "ts")
    return out.drop("ts")


def hourly_errors(t):
    """Mean absolute change of the readings per hour, as one error series."""
    return t.arrivals.select("step", (F.col("total") / F.col("n")).alias("error"))


@query("error_lags", f"""WITH {ARRIVALS}, e AS (SELECT step, total / n AS error FROM arrivals)
SELECT step, round(error, 9) AS error, round(lag_1, 9) AS lag_1, round(lag_2, 9) AS lag_2, round(lag_3, 9) AS lag_3, round(label, 9) AS label
FROM (SELECT step, error, lag(error, 1) OVER w AS lag_1, lag(error, 2) OVER w AS lag_2, lag(error, 3) OVER w AS lag_3, lead(error, 2) OVER w AS label
      FROM e WINDOW w AS (ORDER BY step)) WHERE lag_3 IS NOT NULL AND label IS NOT NULL""")
def _(t):
    out = N.error_lags(hourly_errors(t), None, "step", "error", 3, 2, width_slice("step", 1000))
    return out.select("step", *[F.round(c, 9).alias(c) for c in ("error", "lag_1", "lag_2", "lag_3", "label")])


@query("window_error", f"""WITH {STALENESS}, r AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, query_id) AS rn FROM served WHERE y_pred IS NOT NULL)
SELECT user_id, (rn - 1) // 5 AS block, round(avg(power(y_pred - y_true, 2)), 9) AS mse, count(*) AS n FROM r GROUP BY ALL""")
def _(t):
    p = served(t).where("y_pred IS NOT NULL")
    return N.window_error(p, "user_id", ["ts", "query_id"], 5, hour_slice("ts")).withColumn("mse", F.round("mse", 9))


@query("update_curve", f"""WITH {UPDATES}
SELECT key, policy, time, i, row_number() OVER (PARTITION BY key, policy ORDER BY time, i) AS n_so_far FROM updates""")
def _(t):
    return N.update_curve(t.updates, "key", ["time", "i"], hour_slice("time"))


@query("change_spans", f"""WITH {INDEXED}, changed AS (SELECT key, rn FROM indexed WHERE value > 30),
g AS (SELECT key, rn, rn - row_number() OVER (PARTITION BY key ORDER BY rn) AS run FROM changed)
SELECT key, min(rn) AS start_pos, max(rn) AS end_pos FROM g GROUP BY key, run""")
def _(t):
    marks = indexed(t).where("value > 30").select("key", "rn")
    return N.change_spans(marks, "key", "rn", width_slice("rn", 65_536))


@query("latest_per_key", """SELECT user_id AS key, arg_max(ts, (ts, event_id)) AS ts, arg_max(event_id, (ts, event_id)) AS event_id,
  arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id""")
def _(t):
    return N.latest_per_key(t.readings, "key", ORDER)


@query("top_users", """SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY user_id ORDER BY n DESC, user_id LIMIT 12""")
def _(t):
    return N.top_users(t.events.where("ts >= TIMESTAMP_NTZ '2024-01-05'"), "user_id", 12)


@query("hottest_columns", """WITH heat AS (SELECT user_id AS key, count(*) FILTER (event_type = 'purchase') AS purchase FROM events WHERE event_type <> 'view' GROUP BY 1)
SELECT key, purchase, CAST(row_number() OVER (ORDER BY purchase DESC, key) AS INTEGER) AS rank FROM heat QUALIFY rank <= 10""")
def _(t):
    return N.hottest_columns(update_heatmap(t.updates, "key", POLICIES), "purchase", "key", 10).select("key", "purchase", "rank")


@query("order_events", "SELECT user_id AS key, ts, event_id, value FROM events ORDER BY ts, key, event_id")
def _(t):
    return N.order_events(t.readings, ["ts", "key", "event_id"])


@query("every_nth", f"""WITH {INDEXED}, c AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM indexed)
SELECT key, event_id, value FROM c WHERE (rn - 1) % greatest(n // 10, 1) = 0""")
def _(t):
    return N.every_nth(t.readings, "key", ORDER, 10, hour_slice("ts")).select("key", "event_id", "value")


@query("tagged_union", """SELECT event_id, user_id, value, NULL::VARCHAR AS props, 'views' AS source, 0.5::DOUBLE AS budget FROM events WHERE event_type = 'view'
UNION ALL SELECT event_id, user_id, NULL, props, 'purchases', 2.0::DOUBLE FROM events WHERE event_type = 'purchase'""")
def _(t):
    a = t.events.where("event_type = 'view'").select("event_id", "user_id", "value")
    b = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "props")
    return N.tagged_union([(a, {"source": "views", "budget": 0.5}), (b, {"source": "purchases", "budget": 2.0})])


@query("rows_in_one_side", """SELECT user_id, day FROM (
  SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'view'
  UNION ALL SELECT DISTINCT user_id, CAST(ts AS DATE) FROM events WHERE event_type = 'purchase')
GROUP BY ALL HAVING count(*) = 1""")
def _(t):
    days = t.events.select("user_id", F.to_date("ts").alias("day"), "event_type")
    a = days.where("event_type = 'view'").drop("event_type").distinct()
    b = days.where("event_type = 'purchase'").drop("event_type").distinct()
    return N.rows_in_one_side(a, b, ["user_id", "day"])


@query("dedupe_first", """SELECT user_id AS key, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts,
  arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id""")
def _(t):
    base = t.events.select(F.col("user_id").alias("key"), "event_id", "ts", "event_type")
    return N.dedupe_first(base, "key", ORDER)
