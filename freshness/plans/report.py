"""Section 2.10: metrics and reports."""

from pyspark.sql import functions as F

from freshness.operators import joins as J, report as Q, windows as N
from freshness.operators.docs import hit_at_k
from freshness.operators.ordered import width_slice, with_running
from freshness.plans.aggs import STALENESS, served
from freshness.plans.docs import RANKED, ranked_passages
from freshness.plans.joins import FORECAST_EVAL, INDEXED, forecast_rows
from freshness.plans.registry import query
from freshness.plans.tables import ITEMS, PREDICTIONS, RANK, READINGS, UPDATES, USERS, VERSIONS, VIEWS


def _rounded(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("staleness_by_user", f"""WITH {STALENESS}
SELECT user_id, count(*) AS queries, count(*) FILTER (feature_ts IS NULL) AS unmatched,
  round(avg(date_diff('microsecond', feature_ts, ts) / 1000000), 5) AS mean_staleness, round(avg(power(y_pred - y_true, 2)), 9) AS mse
FROM served GROUP BY user_id""")
def _(t):
    sq = F.pow(F.col("y_pred") - F.col("y_true"), 2)
    return served(t).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.col("feature_ts").isNull()).alias("unmatched"),
        F.round(F.avg(N.staleness("ts", "feature_ts")), 5).alias("mean_staleness"), F.round(F.avg(sq), 9).alias("mse"),
    )


@query("mse", f"WITH {STALENESS} SELECT round(avg(power(y_pred - y_true, 2)), 7) AS mse, count(y_pred) AS n FROM served")
def _(t):
    return _rounded(Q.mse(served(t)), 7, "mse")


SCALED = f"""{FORECAST_EVAL}, fp AS (
  SELECT key, rn, value AS y_true, y_pred, value - lag(value, 2) OVER (PARTITION BY key ORDER BY rn) AS naive FROM fe),
mase AS (SELECT key, avg(abs(y_pred - y_true)) / nullif(avg(abs(naive)), 0) AS scaled_error FROM fp GROUP BY key),
msse AS (SELECT key, avg(power(y_pred - y_true, 2)) / nullif(avg(power(naive, 2)), 0) AS scaled_error FROM fp GROUP BY key)"""


def forecast_p(t):
    return forecast_rows(t).withColumnRenamed("value", "y_true")


@query("mase", f"WITH {SCALED} SELECT key, round(scaled_error, 7) AS scaled_error FROM mase")
def _(t):
    return _rounded(Q.mase(forecast_p(t), "key", "rn", sp=2, rn="rn"), 7, "scaled_error")


@query("mase_total", f"WITH {SCALED} SELECT round(sum(scaled_error), 6) AS total, count(scaled_error) AS n_keys FROM mase")
def _(t):
    return _rounded(Q.total_scaled(Q.mase(forecast_p(t), "key", "rn", sp=2, rn="rn")), 6, "total")


@query("msse", f"WITH {SCALED} SELECT key, round(scaled_error, 7) AS scaled_error FROM msse")
def _(t):
    return _rounded(Q.msse(forecast_p(t), "key", "rn", sp=2, rn="rn"), 7, "scaled_error")


@query("freshness", f"""WITH {STALENESS}
SELECT round(avg(staleness), 7) AS mean_staleness, count(DISTINCT version_id) AS updates_used, count(*) AS n_served
FROM served WHERE version_id IS NOT NULL""")
def _(t):
    return _rounded(Q.freshness(served(t), "version_id", "staleness"), 7, "mean_staleness")


ENDS = f"""{STALENESS}, ends AS (
  SELECT user_id, arg_min(feature, (ts, version_id)) AS f0, arg_max(feature, (ts, version_id)) AS f1 FROM versions GROUP BY user_id)"""


@query("improvement_triple", f"""WITH {ENDS}
SELECT round(avg(power(f0 - y_true, 2)), 7) AS start_mse, round(avg(power(coalesce(y_pred, f0) - y_true, 2)), 7) AS asof_mse,
  round(avg(power(f1 - y_true, 2)), 7) AS final_mse, count(*) AS n FROM served JOIN ends USING (user_id)""")
def _(t):
    out = Q.improvement_triple(t.views, t.versions, "user_id", "ts", "version_id", "feature", "y")
    return _rounded(out, 7, "start_mse", "asof_mse", "final_mse")


@query("query_audit", f"""WITH {ENDS}, clicks AS (SELECT user_id, ts FROM events WHERE event_type = 'click'),
counted AS (
  SELECT s.query_id, count(*) FILTER (c.ts <= feature_ts) AS past, count(*) FILTER (c.ts <= s.ts AND (feature_ts IS NULL OR c.ts > feature_ts)) AS pending
  FROM served s LEFT JOIN clicks c ON s.user_id = c.user_id AND c.ts <= s.ts GROUP BY s.query_id)
SELECT s.query_id, s.user_id, s.ts, y_true AS y, feature_ts, past, pending, f0 AS baseline, f1 AS oracle, coalesce(y_pred, f0) AS prediction,
  round(power(f1 - coalesce(y_pred, f0), 2), 6) AS error
FROM served s JOIN ends USING (user_id) JOIN counted USING (query_id)""")
def _(t):
    clicks = t.events.where("event_type = 'click'").select("user_id", "ts")
    return _rounded(Q.query_audit(t.views, clicks, t.versions, "user_id", "ts", "version_id", "feature", "y"), 6, "error")


@query("feature_loss", f"""WITH {ITEMS}, {USERS}, d AS (SELECT user_id, list_transform(list_zip(user_vec, final_vec), lambda p: p[1] - p[2]) AS gap FROM users)
SELECT user_id, round(sqrt(list_dot_product(gap, gap)), 7) AS distance, round(avg(power(list_dot_product(gap, item_vec), 2)), 7) AS prediction_mse
FROM d, items GROUP BY user_id, gap""")
def _(t):
    return _rounded(Q.feature_loss(t.users, t.items, "user_vec", "final_vec", "item_vec", RANK), 7, "distance", "prediction_mse")


@query("policy_results", f"""WITH {PREDICTIONS},
upd AS (SELECT CASE WHEN l_linenumber > 3 THEN 'item_mean' ELSE 'user_mean' END AS policy, ts AS time FROM ratings)
SELECT e.policy, round(e.mse, 7) AS mse, e.n, u.total_updates, u.last_time
FROM (SELECT policy, avg(power(y_pred - y_true, 2)) AS mse, count(*) AS n FROM predictions GROUP BY policy) e
LEFT JOIN (SELECT policy, count(*) AS total_updates, max(time) AS last_time FROM upd GROUP BY policy) u ON e.policy = u.policy""")
def _(t):
    policy = F.when(F.col("l_linenumber") > 3, "item_mean").otherwise("user_mean").alias("policy")
    updates = t.ratings.select(policy, F.col("ts").alias("time"))
    return _rounded(Q.policy_results(t.predictions, updates, "policy"), 7, "mse")


DAY_ERRORS = """day_errors AS (
  SELECT event_type AS policy, date_diff('day', TIMESTAMP '2024-01-01', ts) AS day, avg(abs(value - 20)) AS error FROM events GROUP BY ALL)"""


def day_errors(t):
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("day")
    return t.events.groupBy(F.col("event_type").alias("policy"), day).agg(F.avg(F.abs(F.col("value") - 20)).alias("error"))


@query("bounds", f"""WITH m AS (SELECT event_type AS policy, avg(abs(value - 20)) AS error FROM events GROUP BY 1)
SELECT policy, round(error, 7) AS error, round((SELECT error FROM m WHERE policy = 'click'), 7) AS lower_bound,
  round((SELECT error FROM m WHERE policy = 'view'), 7) AS upper_bound, round(error - (SELECT error FROM m WHERE policy = 'click'), 7) AS above_bound FROM m""")
def _(t):
    totals = t.events.groupBy(F.col("event_type").alias("policy")).agg(F.avg(F.abs(F.col("value") - 20)).alias("error"))
    return _rounded(Q.bounds(totals, "policy", "error", "view", "click"), 7, "error", "lower_bound", "upper_bound", "above_bound")


@query("best_baseline", f"""WITH {DAY_ERRORS}
SELECT day, round(min(error) FILTER (policy <> 'click'), 9) AS best_other, round(max(error) FILTER (policy = 'click'), 9) AS chosen,
  round(min(error) FILTER (policy <> 'click') - max(error) FILTER (policy = 'click'), 9) AS gain FROM day_errors GROUP BY day""")
def _(t):
    return _rounded(Q.best_baseline(day_errors(t), "day", "policy", "error", "click"), 9, "best_other", "chosen", "gain")


@query("improvement_by_segment", f"""WITH {PREDICTIONS},
seen AS (SELECT DISTINCT user_id FROM ratings WHERE ts < TIMESTAMP '1995-02-01'),
busy AS (SELECT ts FROM ratings GROUP BY ts HAVING count(*) > 28),
p AS (SELECT *, user_id IN (SELECT user_id FROM seen) AS is_seen, ts IN (SELECT ts FROM busy) AS bursty FROM predictions),
l AS (SELECT 'all' AS segment, * FROM p UNION ALL SELECT 'seen', * FROM p WHERE is_seen UNION ALL SELECT 'unseen', * FROM p WHERE NOT is_seen
      UNION ALL SELECT 'bursty', * FROM p WHERE bursty),
m AS (SELECT segment, avg(power(y_pred - y_true, 2)) FILTER (policy = 'user_mean') AS b, avg(power(y_pred - y_true, 2)) FILTER (policy = 'item_mean') AS o FROM l GROUP BY segment)
SELECT segment, round(b, 7) AS base_mse, round(o, 7) AS policy_mse, round(b - o, 7) AS improvement FROM m""")
def _(t):
    seen = t.ratings.where("ts < TIMESTAMP_NTZ '1995-02-01'").select("user_id").distinct().withColumn("_seen", F.lit(True))
    busy = t.ratings.groupBy("ts").agg(F.count(F.lit(1)).alias("n")).where("n > 28").select("ts", F.lit(True).alias("_busy"))
    p = t.predictions.join(seen, "user_id", "left").join(busy, "ts", "left")
    known, bursty = F.coalesce("_seen", F.lit(False)), F.coalesce("_busy", F.lit(False))
    segments = {"all": F.lit(True), "seen": known, "unseen": ~known, "bursty": bursty}
    out = Q.improvement_by_segment(p, segments, "policy", "user_mean", "item_mean")
    return _rounded(out, 7, "base_mse", "policy_mse", "improvement")


@query("user_wins", f"""WITH {PREDICTIONS}, s AS (
  SELECT user_id, sum(abs(y_pred - y_true)) FILTER (policy = 'item_mean') AS ours, sum(abs(y_pred - y_true)) FILTER (policy = 'user_mean') AS other
  FROM predictions GROUP BY user_id)
SELECT user_id, round(ours, 7) AS ours, round(other, 7) AS other FROM s WHERE ours < other * 0.9::DOUBLE""")
def _(t):
    return _rounded(Q.user_wins(t.predictions, "user_id", "policy", "item_mean", "user_mean"), 7, "ours", "other")


@query("update_share", f"""WITH {UPDATES}, {READINGS}
SELECT u.key, u.policy, n_updates, n_points, round(n_updates / n_points, 7) AS share
FROM (SELECT key, policy, count(*) AS n_updates FROM updates GROUP BY ALL) u JOIN (SELECT key, count(*) AS n_points FROM readings GROUP BY key) p ON u.key = p.key""")
def _(t):
    return _rounded(Q.update_share(t.updates, t.readings, "key"), 7, "share")


@query("improvement_vs_rate", f"""WITH {DAY_ERRORS}, g AS (SELECT day, min(error) FILTER (policy <> 'click') - max(error) FILTER (policy = 'click') AS gain FROM day_errors GROUP BY day),
r AS (SELECT date_diff('day', TIMESTAMP '2024-01-01', ts) AS day, count(*) // 10 AS rate FROM events GROUP BY 1)
SELECT rate, round(avg(gain), 7) AS mean_gain, count(gain) AS n FROM g JOIN r ON g.day = r.day GROUP BY rate""")
def _(t):
    gains = Q.best_baseline(day_errors(t), "day", "policy", "error", "click")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("day")
    rates = t.events.groupBy(day).agg(F.floor(F.count(F.lit(1)) / 10).cast("long").alias("rate"))
    return _rounded(Q.improvement_vs_rate(gains, rates, "day", "rate", "gain"), 7, "mean_gain")


@query("error_growth", f"""WITH {INDEXED}, stepped AS (SELECT key, rn, value, abs(value - lag(value) OVER (PARTITION BY key ORDER BY rn)) AS step FROM indexed),
model AS (SELECT key, 30 AS model_t, arg_max(value, rn) AS base, avg(step) AS scale FROM stepped WHERE rn <= 30 GROUP BY key),
a AS (SELECT s.key, rn - model_t AS age, abs(value - (base + 0.1::DOUBLE * (rn - model_t))) / nullif(scale, 0) AS e
      FROM stepped s JOIN model m ON s.key = m.key WHERE rn > model_t AND rn <= model_t + 12)
SELECT key, age, round(sum(e) OVER (PARTITION BY key ORDER BY age), 7) AS total_error FROM a""")
def _(t):
    rows = t.indexed.select("key", "rn", "value")
    slices = width_slice("rn", 65_536)
    stepped = with_running(rows, "key", "rn", slices, {"_p": ("previous", F.col("value"))})
    fit = stepped.where("rn <= 30").groupBy("key").agg(
        F.max_by("value", "rn").alias("base"), F.avg(F.abs(F.col("value") - F.col("_p"))).alias("scale")
    )
    ahead = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.col("base") + F.lit(0.1) * i)
    models = fit.select("key", F.lit(30).cast("long").alias("model_t"), ahead.alias("forecast"), "scale")
    return _rounded(Q.error_growth(rows, models, "key", "rn", "value", 12), 7, "total_error")


WORKERS = [1, 2, 4]


@query("error_by_workers", f"""WITH {VIEWS}, {VERSIONS}, ends AS (SELECT user_id, arg_min(feature, (ts, version_id)) AS f0 FROM versions GROUP BY user_id),
w AS (SELECT unnest([1, 2, 4]) AS workers), late AS (SELECT v.*, workers, v.ts + to_hours(CAST(48 // workers AS INTEGER)) AS ready FROM versions v, w),
s AS (SELECT q.*, w.workers FROM views q, w),
x AS (SELECT s.workers, s.ts, s.y, coalesce(l.feature, f0) AS y_pred, f0 FROM s ASOF LEFT JOIN late l ON s.user_id = l.user_id AND s.workers = l.workers AND s.ts >= l.ready
      JOIN ends e ON e.user_id = s.user_id)
SELECT workers, round(avg(power(y_pred - y, 2)), 7) AS mse_all, round(avg(power(f0 - y, 2)), 7) AS start_mse_all, round(avg(power(y_pred - f0, 2)), 7) AS distance_all,
  round(avg(power(y_pred - y, 2)) FILTER (ts > TIMESTAMP '2024-01-10'), 7) AS mse_late, round(avg(power(f0 - y, 2)) FILTER (ts > TIMESTAMP '2024-01-10'), 7) AS start_mse_late,
  round(avg(power(y_pred - f0, 2)) FILTER (ts > TIMESTAMP '2024-01-10'), 7) AS distance_late FROM x GROUP BY workers""")
def _(t):
    start = t.versions.groupBy("user_id").agg(F.min_by("feature", F.struct("ts", "version_id")).alias("y_start"))
    parts = []
    for workers in WORKERS:
        ready = t.versions.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {48 // workers} HOURS"))
        seen = J.asof_left(t.views, ready, "user_id", "ts", "version_id", ["feature"]).join(start, "user_id")
        parts.append((seen.select("ts", F.col("y").alias("y_true"), F.coalesce("feature", "y_start").alias("y_pred"), "y_start"), workers))
    out = Q.error_by_workers(parts, "ts", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return _rounded(out, 7, *[c for c in out.columns if c != "workers"])


@query("slide_error", f"""WITH {INDEXED}, f AS (SELECT *, first_value(value) OVER (PARTITION BY key ORDER BY rn) AS v0 FROM indexed),
sl AS (SELECT unnest([4, 8, 16]) AS slide),
m AS (SELECT key, slide, rn AS m_rn, value AS base, (value - v0) / nullif(rn - 1, 0) AS drift FROM f, sl WHERE rn >= 24 AND (rn - 24) % slide = 0),
q AS (SELECT key, rn, value, slide FROM f, sl),
s AS (SELECT q.key, q.slide, q.rn, q.value AS y_true, base + drift * (q.rn - m_rn) AS y_pred FROM q ASOF JOIN m ON q.key = m.key AND q.slide = m.slide AND q.rn >= m.m_rn),
n AS (SELECT *, y_true - lag(y_true) OVER (PARTITION BY key, slide ORDER BY rn) AS naive FROM s)
SELECT key, slide, round(avg(abs(y_pred - y_true)) / nullif(avg(abs(naive)), 0), 7) AS scaled_error FROM n GROUP BY key, slide""")
def _(t):
    rows = t.indexed.select("key", "rn", "event_id", "value")
    return _rounded(Q.slide_error(rows, "key", "rn", "value", 24, [4, 8, 16], "event_id", width_slice("rn", 4096)), 7, "scaled_error")


@query("workload_table", f"""WITH {PREDICTIONS}, {SCALED}, {RANKED},
h AS (SELECT question_id, max(CASE WHEN (question_id + passage_id) % 7 = 0 THEN 1 ELSE 0 END) AS hit FROM ranked WHERE rank <= 5 GROUP BY 1)
SELECT 'recommendation' AS workload, policy, round(avg(power(y_pred - y_true, 2)), 6) AS error FROM predictions GROUP BY policy
UNION ALL SELECT 'anomaly', 'every_8', round(sum(scaled_error), 6) FROM mase
UNION ALL SELECT 'retrieval', 'current', round(1 - avg(hit), 6) FROM h""")
def _(t):
    sq = F.pow(F.col("y_pred") - F.col("y_true"), 2)
    rec = t.predictions.groupBy("policy").agg(F.avg(sq).alias("error"))
    total = Q.total_scaled(Q.mase(forecast_p(t), "key", "rn", sp=2, rn="rn"))
    hits = ranked_passages(t).withColumn("hit", ((F.col("question_id") + F.col("passage_id")) % 7 == 0).cast("int"))
    found = hit_at_k(hits, "question_id", "hit")
    parts = {
        "recommendation": rec,
        "anomaly": total.select(F.lit("every_8").alias("policy"), F.col("total").alias("error")),
        "retrieval": found.select(F.lit("current").alias("policy"), (1 - F.col("top5")).alias("error")),
    }
    return _rounded(Q.workload_table(parts), 6, "error")
