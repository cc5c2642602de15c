"""Section 2.9: refresh priority."""

from pyspark.sql import functions as F

from freshness.operators import allocation as A, joins as J, priority as R
from freshness.operators.ordered import day_slice, hour_slice, width_slice
from freshness.plans.joins import INDEXED
from freshness.plans.registry import query

# Clicks are events, purchases are updates, views are queries with error |y - 25|.
INPUTS = """last_u AS (SELECT user_id AS key, max(ts) AS last_update, count(*) AS past FROM events WHERE event_type = 'purchase' GROUP BY 1),
inputs AS (
  SELECT e.user_id AS key,
    count(*) FILTER (event_type = 'click' AND (u.last_update IS NULL OR ts > u.last_update)) AS pending,
    round(coalesce(sum(abs(value - 25)) FILTER (event_type = 'view' AND (u.last_update IS NULL OR ts > u.last_update)), 0), 6) AS error_since,
    count(*) FILTER (event_type = 'view' AND (u.last_update IS NULL OR ts > u.last_update)) AS queries_since,
    max(ts) FILTER (event_type = 'click') AS last_event, max(ts) FILTER (event_type = 'view') AS last_query,
    any_value(u.last_update) AS last_update, coalesce(any_value(u.past), 0) AS past_updates
  FROM events e LEFT JOIN last_u u ON e.user_id = u.key WHERE event_type IN ('click', 'purchase', 'view') GROUP BY e.user_id)"""

NOW = "2024-01-31 00:00:00"


def inputs(t):
    keyed = t.events.select(F.col("user_id").alias("key"), "ts", "event_type", "value")
    of = lambda kind: keyed.where(F.col("event_type") == kind)
    asked = of("view").select("key", "ts", F.abs(F.col("value") - 25).alias("error"))
    return R.priority_inputs(of("click"), of("purchase"), asked, "key", "ts")


def _rank_sql(score, where="pending > 0"):
    return f"""WITH {INPUTS}
SELECT key, score, row_number() OVER (ORDER BY score DESC, key) AS rank
FROM (SELECT key, {score} AS score FROM inputs WHERE {where}) WHERE score IS NOT NULL"""


@query("priority_inputs", f"WITH {INPUTS} SELECT * FROM inputs")
def _(t):
    return inputs(t)


@query("rank_total_error", _rank_sql("error_since"))
def _(t):
    return R.rank_keys(inputs(t), "key", R.total_error())


@query("rank_total_error_cold", _rank_sql("CASE WHEN past_updates = 0 THEN 1000000::DOUBLE ELSE error_since END"))
def _(t):
    return R.rank_keys(inputs(t), "key", R.total_error_cold())


@query("rank_last_query", _rank_sql("epoch_us(last_query)"))
def _(t):
    return R.rank_keys(inputs(t), "key", R.last_query())


@query("rank_max_pending", _rank_sql("pending"))
def _(t):
    return R.rank_keys(inputs(t), "key", R.max_pending())


@query("rank_min_past", _rank_sql("round(1.0::DOUBLE / (past_updates + 1), 9)"))
def _(t):
    return R.rank_keys(inputs(t), "key", F.round(R.min_past(), 9))


@query("rank_round_robin", _rank_sql(f"coalesce(epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_update), 4611686018427387904)"))
def _(t):
    return R.rank_keys(inputs(t), "key", R.round_robin(F.lit(NOW).cast("timestamp_ntz")))


@query("rank_query_proportional", _rank_sql("queries_since"))
def _(t):
    return R.rank_keys(inputs(t), "key", R.query_proportional())


@query("rank_query_proportional_cold", _rank_sql("CASE WHEN past_updates = 0 THEN 1e8::DOUBLE ELSE queries_since::DOUBLE END"))
def _(t):
    return R.rank_keys(inputs(t), "key", R.query_proportional_cold())


@query("rank_random")
def _(t):
    return R.rank_keys(inputs(t), "key", R.random_score("key", 5))


@query("rank_max_staleness", _rank_sql(f"round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_update)) / 1000000, 6)", "true"))
def _(t):
    age = F.round(R.max_staleness(F.lit(NOW).cast("timestamp_ntz")), 6)
    return R.rank_keys(inputs(t), "key", age, pending_only=False)


FORECAST_ERRORS = f"""{INDEXED},
stepped AS (SELECT key, rn, value, lag(value) OVER (PARTITION BY key ORDER BY rn) AS prev FROM indexed),
model AS (SELECT key, 40 AS model_t, value AS base FROM indexed WHERE rn = 40),
fe AS (
  SELECT s.key, count(*) FILTER (model_t IS NULL OR rn > model_t) AS pending,
    CASE WHEN bool_or(model_t IS NULL) THEN 1e6::DOUBLE ELSE round(sum(abs(value - (base + 0.1::DOUBLE * (rn - model_t)))) FILTER (rn > model_t)
      / nullif(avg(abs(value - prev)) FILTER (rn <= model_t), 0), 6) END AS error
  FROM stepped s LEFT JOIN model m ON s.key = m.key GROUP BY s.key)"""


def forecast_error_table(t):
    rows = t.indexed.select("key", "rn", "value")
    models = rows.where("rn = 40").select("key", F.col("rn").alias("model_t"), F.col("value").alias("base"))
    predicted = F.col("base") + F.lit(0.1) * (F.col("rn") - F.col("model_t"))
    return R.forecast_errors(rows, models, predicted, "key", "rn", "rn", "value", width_slice("rn", 65_536))


@query("rank_forecast_error", f"""WITH {FORECAST_ERRORS}
SELECT key, error AS score, row_number() OVER (ORDER BY error DESC, key) AS rank FROM fe WHERE pending > 0 AND error IS NOT NULL""")
def _(t):
    return R.rank_keys(forecast_error_table(t), "key", R.forecast_error_score())


@query("rank_forecast_error_epsilon", f"""WITH {FORECAST_ERRORS}, s AS (
  SELECT key, greatest(key % 40 + 2.5::DOUBLE, error) AS score FROM fe WHERE pending > 0 AND error IS NOT NULL)
SELECT key, score, row_number() OVER (ORDER BY score DESC, key) AS rank FROM s""")
def _(t):
    errors = forecast_error_table(t).where("error IS NOT NULL")
    return R.rank_keys(errors, "key", R.forecast_error_score(F.col("key") % 40, 2.5))


WEIGHTS = """weights AS (SELECT user_id AS key, date_trunc('day', ts) AS ts, count(*) AS weight FROM events WHERE event_type = 'view' GROUP BY ALL)"""


def day_weights(t):
    day = F.to_date("ts").cast("timestamp_ntz")
    return t.views.groupBy(F.col("user_id").alias("key"), day.alias("ts")).agg(F.count(F.lit(1)).alias("weight"))


@query("weights_at", f"""WITH {WEIGHTS}, q AS (SELECT event_id, user_id AS key, ts FROM events WHERE event_type = 'click')
SELECT event_id, q.key, q.ts, w.ts AS feature_ts, w.weight FROM q ASOF LEFT JOIN weights w ON q.key = w.key AND q.ts >= w.ts""")
def _(t):
    clicks = t.events.where("event_type = 'click'").select("event_id", F.col("user_id").alias("key"), "ts")
    return J.asof_left(clicks, day_weights(t), "key", "ts", "weight", ["weight"])


@query("rank_weighted", f"""WITH {INPUTS}, w AS (SELECT user_id AS key, count(*) AS weight FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT i.key, weight * pending AS score, row_number() OVER (ORDER BY weight * pending DESC, i.key) AS rank
FROM inputs i JOIN w ON i.key = w.key WHERE pending > 0""")
def _(t):
    weights = t.views.groupBy(F.col("user_id").alias("key")).agg(F.count(F.lit(1)).alias("weight"))
    return R.rank_keys(inputs(t).join(weights, "key"), "key", R.weighted_pending())


@query("rank_weighted_draw")
def _(t):
    weights = t.views.groupBy(F.col("user_id").alias("key")).agg(F.count(F.lit(1)).alias("weight"))
    return R.rank_keys(inputs(t).join(weights, "key"), "key", R.weighted_draw("key", 5))


@query("take_budget", _rank_sql("error_since") + " QUALIFY rank <= 10")
def _(t):
    return R.take_budget(R.rank_keys(inputs(t), "key", R.total_error()), 10)


DAILY = """daily AS (SELECT date_diff('day', TIMESTAMP '2024-01-01', ts) + 1 AS round, user_id AS key, count(*) AS score FROM events GROUP BY ALL)"""


def daily_counts(t):
    first = day_slice(F.lit("2024-01-01").cast("timestamp_ntz"))
    return t.events.groupBy((day_slice("ts") - first + 1).alias("round"), F.col("user_id").alias("key")).agg(
        F.count(F.lit(1)).alias("score")
    )


@query("take_budget_rounds", f"""WITH {DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY score DESC, key) AS rank FROM daily)
SELECT round, key, score, rank FROM r WHERE rank <= floor(round * 2.5::DOUBLE) - floor((round - 1) * 2.5::DOUBLE)""")
def _(t):
    return R.take_budget_rounds(daily_counts(t), "key", "round", 2.5)


@query("batch_when_affordable", """WITH h AS (SELECT date_diff('hour', TIMESTAMP '2024-01-01', ts) + 1 AS round, count(*) AS n FROM events GROUP BY 1),
s AS (SELECT round, CAST(sum(n) OVER (ORDER BY round) AS BIGINT) AS seen FROM h),
p AS (SELECT * FROM s WHERE round * 13.9::DOUBLE >= seen)
SELECT round, seen - coalesce(lag(seen) OVER (ORDER BY round), 0) AS refreshed FROM p""")
def _(t):
    rounds = t.arrivals.select((F.col("step") + 1).alias("round"), "n")
    return R.batch_when_affordable(rounds, "round", "n", 13.9, width_slice("round", 1000))


@query("shed_oldest", """SELECT user_id AS key, ts, event_id, value FROM events
QUALIFY count(*) OVER (PARTITION BY user_id) <= 66 OR row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 33""")
def _(t):
    return R.shed_oldest(t.readings, "key", ["ts", "event_id"], 66, hour_slice("ts"))


@query("shed_sample", "SELECT user_id AS key, ts, event_id, value FROM events WHERE (event_id * 7919) % 1000 < 300")
def _(t):
    return R.shed_sample(t.readings, "event_id", 0.3)


@query("static_plan", f"""WITH n AS (SELECT user_id AS key, count(*) AS length, 4 + user_id % 5 AS slide FROM events GROUP BY ALL)
SELECT key, length, slide, unnest(range(24, length + 1, slide)) AS time FROM n WHERE length >= 24""")
def _(t):
    keys = t.readings.groupBy("key").agg(F.count(F.lit(1)).alias("length")).withColumn("slide", 4 + F.col("key") % 5)
    return R.static_plan(keys, 24, "length", "slide")


@query("static_plan_of_fits", f"""WITH n AS (SELECT user_id AS key, count(*) AS length, 1 + user_id % 5 AS fits FROM events GROUP BY ALL),
x AS (SELECT *, unnest(range(0, fits)) AS i FROM n)
SELECT key, length, fits, CAST(24 + floor((length - 24) * i / fits) AS BIGINT) AS time FROM x""")
def _(t):
    keys = t.readings.groupBy("key").agg(F.count(F.lit(1)).alias("length")).withColumn("fits", 1 + F.col("key") % 5)
    return R.static_plan_of_fits(keys, 24, "length", "fits")


LOSS = """loss AS (
  SELECT key, n_fits, round(spread / (n_fits + 1), 9) AS loss
  FROM (SELECT user_id AS key, sum(value) AS spread FROM events GROUP BY 1), (SELECT unnest(range(0, 9)) AS n_fits))"""


def loss_table(t):
    spread = t.readings.groupBy("key").agg(F.sum("value").alias("spread"))
    fits = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long")))
    return spread.withColumn("n_fits", fits).select("key", "n_fits", F.round(F.col("spread") / (F.col("n_fits") + 1), 9).alias("loss"))


@query("allocate_fits", f"""WITH {LOSS}, g AS (
  SELECT key, n_fits, round(lag(loss) OVER (PARTITION BY key ORDER BY n_fits) - loss, 6) AS gain FROM loss),
r AS (SELECT *, row_number() OVER (ORDER BY gain DESC, key, n_fits) AS rank FROM g WHERE gain > 0)
SELECT l.key, count(r.key) AS n_fits FROM (SELECT DISTINCT key FROM loss) l LEFT JOIN r ON l.key = r.key AND rank <= 400 GROUP BY l.key""")
def _(t):
    return R.allocate_fits(loss_table(t), "key", "n_fits", "loss", 400, 6)


@query("allocate_fits_any", f"""WITH {LOSS}, g AS (
  SELECT key, n_fits, lag(loss) OVER (PARTITION BY key ORDER BY n_fits) - loss AS gain FROM loss WHERE n_fits % 2 = 0),
r AS (SELECT *, row_number() OVER (ORDER BY gain DESC, key, n_fits) AS rank FROM g WHERE gain > 0)
SELECT l.key, 2 * count(r.key) AS n_fits FROM (SELECT DISTINCT key FROM loss) l LEFT JOIN r ON l.key = r.key AND rank <= 200 GROUP BY l.key""")
def _(t):
    """A single fit saves nothing here and a pair of fits does, so a choice by the next fit alone finds no gain."""
    even = loss_table(t).where("n_fits % 2 = 0")
    steps = even.withColumn("n_fits", F.explode(F.array("n_fits", F.col("n_fits") + 1)))
    return A.allocate_fits_any(steps, "key", "n_fits", "loss", 400)


@query("slide_for_fits", """SELECT user_id AS key, CAST(round(count(*) / (2 + user_id % 7)) AS BIGINT) AS slide FROM events GROUP BY user_id""")
def _(t):
    keys = t.readings.groupBy("key").agg(F.count(F.lit(1)).alias("length")).withColumn("fits", 2 + F.col("key") % 7)
    return keys.select("key", R.slide_for_fits("length", "fits").alias("slide"))
