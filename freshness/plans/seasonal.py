"""Section 2.8, second part: seasonal series and error models."""

from pyspark.sql import functions as F

from freshness.operators import joins as J, priority as R, seasonal as Z, windows as N
from freshness.operators.ordered import hour_slice, width_slice
from freshness.plans.aggs import STALENESS, served
from freshness.plans.joins import INDEXED
from freshness.plans.priority import inputs
from freshness.plans.registry import query
from freshness.plans.windows import ORDER, hourly_errors, windows24

DECOMPOSED = f"""{INDEXED}, tr AS (
  SELECT *, CASE WHEN count(*) OVER w = 7 THEN (sum(value) OVER w - (lag(value, 3) OVER (PARTITION BY key ORDER BY rn) + lead(value, 3) OVER (PARTITION BY key ORDER BY rn)) / 2) / 6 END AS trend,
    (rn - 1) % 6 AS phase
  FROM indexed WINDOW w AS (PARTITION BY key ORDER BY rn ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
seas AS (SELECT key, phase, avg(value - trend) AS season FROM tr GROUP BY key, phase)"""


@query("seasonal_means", f"WITH {DECOMPOSED} SELECT key, phase, round(season, 7) AS season FROM seas")
def _(t):
    out = Z.seasonal_means(t.readings, "key", ORDER, "value", 6, hour_slice("ts"))
    return out.withColumn("season", F.round("season", 7))


@query("oracle_decompose", f"""WITH {DECOMPOSED}
SELECT event_id, tr.key, rn, round(trend, 7) AS trend, round(season, 7) AS season, round(value - trend - season, 7) AS residual
FROM tr JOIN seas ON tr.key = seas.key AND tr.phase = seas.phase""")
def _(t):
    out = Z.oracle_decompose(t.readings, "key", ORDER, "value", 6, hour_slice("ts"))
    return out.select("event_id", "key", "rn", *[F.round(c, 7).alias(c) for c in ("trend", "season", "residual")])


@query("drift_forecast", f"""WITH {DECOMPOSED}, e AS (
  SELECT key, max(rn) AS n, min(rn) FILTER (trend IS NOT NULL) AS a, max(rn) FILTER (trend IS NOT NULL) AS b,
    arg_min(trend, rn) FILTER (trend IS NOT NULL) AS first, arg_max(trend, rn) FILTER (trend IS NOT NULL) AS last FROM tr GROUP BY key),
s AS (SELECT *, unnest(range(1, 13)) AS step FROM e)
SELECT s.key, n, CAST(step AS INTEGER) AS step, round(last + coalesce((last - first) / nullif(b - a, 0), 0) * (n + step - b) + season, 7) AS forecast
FROM s JOIN seas ON s.key = seas.key AND seas.phase = (n + step - 1) % 6""")
def _(t):
    out = Z.drift_forecast(t.readings, "key", ORDER, "value", 6, 12, hour_slice("ts"))
    return out.withColumn("forecast", F.round("forecast", 7))


@query("seasonal_features")
def _(t):
    out = Z.seasonal_features(windows24(t), 6)
    return out.select("key", "window", "end_rn", "trend", F.posexplode_outer("season").alias("phase", "season"))


@query("seasonal_forecast")
def _(t):
    out = Z.seasonal_forecast(windows24(t), 6, 8)
    return out.select("key", "window", "end_rn", F.posexplode_outer("forecast").alias("step", "forecast"))


@query("rolling_seasonal")
def _(t):
    out = Z.rolling_seasonal(t.readings, "key", ORDER, "value", 24, 6, hour_slice("ts"))
    return out.select("key", "end_rn", "trend", F.posexplode_outer("season").alias("phase", "season"))


@query("repair_anomalies")
def _(t):
    flagged = t.events.select(F.col("user_id").alias("key"), "ts", "event_id", "value", (F.col("value") > 90).alias("is_anomaly"))
    return Z.repair_anomalies(flagged, "key", ORDER, "value", "is_anomaly", 24, 6, hour_slice("ts"))


@query("extend_series")
def _(t):
    rows = Z.oracle_decompose(t.readings, "key", ORDER, "value", 6, hour_slice("ts"))
    base = rows.select("key", "rn", F.coalesce("trend", "value").alias("trend"), "season", F.coalesce("residual", F.lit(0.0)).alias("noise"))
    return Z.extend_series(base, "key", "rn", "trend", "season", "noise", 200, 6, 0.05, 3)


@query("staleness_regression", f"""WITH {STALENESS}
SELECT user_id, round(regr_slope(abs(y_pred - y_true), staleness), 7) AS slope, round(regr_intercept(abs(y_pred - y_true), staleness), 7) AS intercept, count(y_pred) AS n
FROM served GROUP BY user_id""")
def _(t):
    p = served(t).withColumn("error", F.abs(F.col("y_pred") - F.col("y_true")))
    out = Z.staleness_regression(p, "user_id", "staleness", "error")
    return out.withColumn("slope", F.round("slope", 7)).withColumn("intercept", F.round("intercept", 7))


FACTORS = ["staleness", "past", "pending"]


def factor_rows(t):
    """Served queries with staleness, past and pending counts and their error."""
    clicks = t.events.where("event_type = 'click'").select("user_id", "ts")
    counted = J.count_before(t.views.drop("y"), clicks, t.versions.select("user_id", "ts"), "user_id", "ts")
    p = served(t).where("y_pred IS NOT NULL").withColumn("error", F.abs(F.col("y_pred") - F.col("y_true")))
    return p.join(counted.select("query_id", "past", "pending"), "query_id")


@query("error_model")
def _(t):
    rows = factor_rows(t).select("query_id", "error", *FACTORS)
    model = Z.error_model(rows, FACTORS, "error")
    return Z.predicted_error(model, rows, FACTORS)


@query("rank_learned")
def _(t):
    model = Z.error_model(factor_rows(t), FACTORS, "error")
    first = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")  # a key that was never updated is as stale as the data are old
    keys = inputs(t).withColumn("last_update", F.coalesce("last_update", first))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    state = keys.select(
        "key", "pending", F.col("past_updates").alias("past"), (hour_slice(now) - hour_slice("last_update")).alias("staleness")
    )
    return R.rank_keys(Z.predicted_error(model, state, FACTORS), "key", F.col("prediction"))


@query("error_regression")
def _(t):
    lags = N.error_lags(hourly_errors(t), None, "step", "error", 5, 2, width_slice("step", 1000))
    train, test = lags.where("step < 360"), lags.where("step >= 360")
    return Z.error_regression(train, [f"lag_{i}" for i in range(1, 6)], "label", test, 0.5, 0.1)


@query("error_forecast")
def _(t):
    p = served(t).where("y_pred IS NOT NULL").withColumn("error", F.abs(F.col("y_pred") - F.col("y_true")))
    return Z.error_forecast(p, "user_id", ["ts", "query_id"], "error", 5, 1, hour_slice("ts"))
