"""Sections 2.11 and 2.12: streams over the given tables, and user functions.

Each streaming query drains its source with an available-now trigger into a
fresh folder and returns what was written.
"""

import uuid

from pyspark.sql import functions as F

from freshness.functions import udfs as U
from freshness.functions.scalars import biased_rating, passage_arrays, split_sentences
from freshness.operators import priority as R, report as Q
from freshness.operators.factors import gram_sums, ridge_fit
from freshness.plans.io import fresh_folder
from freshness.plans.registry import query
from freshness.plans.tables import RANK, RATINGS, READINGS, SENTENCES_SQL
from freshness.plans.windows import WINDOWS, windows24
from freshness.sources import io as S
from freshness.session import stage
from freshness.streaming import maintenance as M, streams as T

FILES = 4  # batches of a replay
PART_ROWS = 16_384  # documents in one file of a replay


def replay(t, df, order, files=FILES, parts=1):
    path = fresh_folder(t, "replay")
    S.write_replay(df, order, path, files, parts)
    return S.replay_source(t.spark, path, t.spark.read.parquet(path).schema, parts)


def drain(t, stream, mode="append"):
    """Run a stream to its end into Parquet files and read them."""
    out, marks = fresh_folder(t, "out"), fresh_folder(t, "marks")
    sink = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", marks)
    sink.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out)


def drain_windows(t, stream, key):
    """Run an aggregated stream to its end and read the last state of every window, open ones included."""
    out, marks = fresh_folder(t, "windows"), fresh_folder(t, "marks")
    T.stream_table(stream, out, marks).trigger(availableNow=True).start().awaitTermination()
    return T.current_table(t.spark, out, key)


@query("replay_source", f"WITH {READINGS} SELECT * FROM readings")
def _(t):
    return drain(t, replay(t, t.readings, ["ts", "event_id"]))


@query("feature_log_sink", "SELECT event_id AS version_id, user_id, ts, value AS feature FROM events WHERE event_type = 'purchase'")
def _(t):
    out, marks = fresh_folder(t, "log"), fresh_folder(t, "marks")
    stream = replay(t, t.versions, ["ts", "version_id"])
    S.feature_log_sink(stream, out, marks).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out)


@query("console_or_memory_sink", "SELECT event_type, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY event_type")
def _(t):
    """One row for each event type in a table in memory, which suits results of a known small size only."""
    rows = replay(t, t.events.select("event_type", "ts", "event_id"), ["ts", "event_id"])
    counts = rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))
    name = f"seen_{uuid.uuid4().hex}"
    sink = S.console_or_memory_sink(counts, name, "complete").option("checkpointLocation", fresh_folder(t, "marks"))
    sink.trigger(availableNow=True).start().awaitTermination()
    return t.spark.table(name)


@query("stream_tumbling", """WITH e AS (
  SELECT user_id AS key, date_trunc('hour', ts) AS h, value, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS w FROM events)
SELECT key, h AS window_start, h + INTERVAL 1 HOUR AS window_end, round(sum(value * w) / nullif(sum(w), 0), 7) AS weighted_avg, count(*) AS n
FROM e GROUP BY key, h""")
def _(t):
    rows = t.events.select(
        F.col("user_id").alias("key"), "ts", "value", F.regexp_extract("props", "[0-9]+", 0).cast("double").alias("w"), "event_id"
    )
    stream = T.stream_watermark(replay(t, rows, ["ts", "event_id"]), "ts", "1 hour")
    out = drain_windows(t, T.stream_tumbling(stream, "key", "ts", "value", "w"), ["key", "window_start", "window_end"])
    ntz = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return out.withColumns(ntz).withColumn("weighted_avg", F.round("weighted_avg", 7))


@query("stream_watermark", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n FROM events GROUP BY 1")
def _(t):
    stream = T.stream_watermark(replay(t, t.readings, ["ts", "event_id"]), "ts", "2 hours")
    out = drain_windows(t, stream.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")), "w")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "n")


@query("stream_count_windows", f"""WITH {WINDOWS} SELECT key, "window", end_rn, round(list_sum(vals), 6) AS total FROM wins""")
def _(t):
    stream = replay(t, t.readings, ["ts", "event_id"])
    out = drain(t, T.stream_count_windows(stream, "key", ["ts", "event_id"], "value", 24, 8))
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return out.select("key", "window", "end_rn", F.round(total, 6).alias("total"))


def published(t):
    log, marks = fresh_folder(t, "features"), fresh_folder(t, "marks")
    stream = replay(t, t.versions, ["ts", "version_id"])
    writer = T.stream_latest(stream, log, marks, "user_id", ["ts", "version_id"])
    started = writer.trigger(availableNow=True).start()
    started.awaitTermination()
    return started, log


@query("stream_latest", """SELECT user_id, arg_max(event_id, (ts, event_id)) AS version_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS feature
FROM events WHERE event_type = 'purchase' GROUP BY user_id""")
def _(t):
    _started, log = published(t)
    return T.current_features(t.spark, log, "user_id", ["ts", "version_id"])


@query("stream_output_lag", """SELECT user_id, max(ts) AS ts, round(date_diff('microsecond', max(ts), (SELECT max(ts) FROM events)) / 1000000, 6) AS lag_seconds
FROM events WHERE event_type = 'purchase' GROUP BY user_id""")
def _(t):
    _started, log = published(t)
    current = T.current_features(t.spark, log, "user_id", ["ts", "version_id"])
    out = T.stream_output_lag(t.events, current, "ts", "ts")
    return out.select("user_id", "ts", F.round("lag_seconds", 6).alias("lag_seconds"))


@query("stream_metrics")
def _(t):
    started, _log = published(t)
    return T.stream_metrics(started)


def edit_records(t):
    passages = passage_arrays(split_sentences("text"), 10)
    rows = t.documents.select("doc_id", F.col("doc_id").alias("ts"), passages.alias("texts"))
    return rows.withColumn("ids", F.sequence(F.lit(0), F.size("texts") - 1))


@query("stream_explode_passages", f"""SELECT doc_id, doc_id AS ts, CAST(pos // 10 AS INTEGER) AS pass_id, md5(string_agg(sentence, ' ' ORDER BY pos)) AS hash
FROM (SELECT doc_id, unnest(s) AS sentence, unnest(range(len(s))) AS pos FROM (SELECT doc_id, {SENTENCES_SQL.format(text='text')} AS s FROM documents))
GROUP BY doc_id, pos // 10""")
def _(t):
    parts = max(1, -(-t.documents.count() // (2 * PART_ROWS)))
    out = drain(t, T.stream_explode_passages(replay(t, edit_records(t), "ts", 2, parts), "doc_id", "ids", "texts", "ts"))
    return out.select("doc_id", "ts", "pass_id", F.md5("pass_text").alias("hash"))


@query("stream_collect_doc", """SELECT user_id AS doc_id, count(DISTINCT event_type) AS n_passages, max(epoch_us(ts)) AS ts FROM events GROUP BY user_id""")
def _(t):
    rows = t.events.select(
        F.col("user_id").alias("doc_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("event_type").alias("pass_id"), F.col("props").alias("pass_text"),
    )
    states = drain(t, T.stream_collect_doc(replay(t, rows, ["ts", "pass_id"]), "doc_id", "ts"))
    last = states.groupBy("doc_id").agg(F.max_by("pass_ids", "ts").alias("ids"), F.max("ts").alias("ts"))
    return last.select("doc_id", F.size("ids").cast("long").alias("n_passages"), "ts")


def ridge_model():
    """Item vectors whose last slot is a bias, user vectors by ridge regression on the first seven."""
    size = RANK - 1
    sums = lambda events: gram_sums(events, "user_id", "item_vec", F.col("rating") - F.element_at("item_vec", -1), size)
    fit = lambda: ridge_fit("n", "sum_y", "sum_x", "rhs", "gram", F.lit(0.001))
    return M.Model(sums, fit, lambda: biased_rating("feature", "item_vec"), 3.0)


def mean_model():
    """The mean rating of a user so far."""
    sums = lambda events: events.groupBy("user_id").agg(F.count("rating").alias("n"), F.sum("rating").alias("total"))
    return M.Model(sums, lambda: F.array(F.col("total") / F.col("n")), lambda: F.element_at("feature", 1), 3.0)


def _start(t, stream, path, runs, model, known=None):
    job = M.Maintenance(t.spark, path, runs, model, "user_id", "rating", ["item_id", "ts"], known)
    M.stream_maintain(stream, fresh_folder(t, "marks"), job).trigger(availableNow=True).start().awaitTermination()
    return job


def maintained(t, budget=50.5):
    """A maintenance run over the ratings in time order: four rounds, worst summed error first."""
    stream = replay(t, t.ratings.select("user_id", "item_id", "ts", "rating", "l_orderkey"), ["ts", "l_orderkey"]).join(t.items, "item_id")
    return _start(t, stream, fresh_folder(t, "maintain"), [M.Run("total_error", budget, lambda r: R.total_error())], ridge_model())


@query("stream_maintain")
def _(t):
    predictions = maintained(t).table("predictions")
    sq = F.pow(F.col("y_pred") - F.col("y_true"), 2)
    return predictions.groupBy(F.col("round_no").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.avg(sq).alias("mse"))


@query("stream_maintain_updates")
def _(t):
    return maintained(t).table("updates").select(F.col("round_no").alias("batch"), "user_id", "score", "pending")


BUDGETS = [20.5, 60.0]
POLICIES = {  # column form, SQL form; {r} is the round
    "total_error": (lambda r: F.round(R.total_error(), 6), "round(error_since, 6)"),
    "total_error_cold": (lambda r: F.round(R.total_error_cold(), 6), "CASE WHEN past_updates = 0 THEN 1e6 ELSE round(error_since, 6) END"),
    "query_proportional": (lambda r: R.query_proportional(), "queries_since"),
    "max_pending": (lambda r: R.max_pending(), "pending"),
    "min_past": (lambda r: R.min_past(), "1.0::DOUBLE / (past_updates + 1)"),
    "round_robin": (lambda r: F.coalesce(F.lit(r) - F.col("last_update"), F.lit(1 << 40)), "coalesce({r} - last_update, 1099511627776)"),
    "last_query": (lambda r: F.col("last_query"), "last_query"),
    "random": (lambda r: (F.col("user_id") * 7919 + (r + 1) * 104729) % 100003, "(user_id * 7919 + ({r} + 1) * 104729) % 100003"),
}
SWEEP = [(p, b) for p in POLICIES for b in BUDGETS] + [("batch", b) for b in BUDGETS] + [("round_robin", 0.0), ("round_robin", None)]
YEARS = range(7)  # rounds of the SQL twin: the years of the orders, from the first


def in_catalogue(t, stream):
    """`listed` for the events of items that are in the catalogue; it grows with the items, whatever its compressed files look like."""
    catalogue = t.items.where("item_id % 40 <> 0").select("item_id", F.lit(True).alias("listed"))
    return stream.join(M.by_merge(catalogue), "item_id", "left")


def swept(t):
    """All policies under all budgets over the ratings, one round a year; every 40th item is not in the catalogue yet."""
    path = fresh_folder(t, "steps")
    rows = t.ratings.select("user_id", "item_id", "ts", "rating", "l_orderkey", F.year("ts").alias("step"))
    S.write_steps(rows, "step", ["ts", "l_orderkey"], path)
    stream = S.replay_source(t.spark, path, rows.schema).drop("_folder")
    runs = [M.Run(p, b, POLICIES[p][0] if p in POLICIES else None) for p, b in SWEEP]
    return _start(t, in_catalogue(t, stream), fresh_folder(t, "sweep"), runs, mean_model(), F.col("listed"))


def _round_sql(r):
    """CTEs of one round: predictions, state with the round's events, choices, state after."""
    before = f"state_{r - 1}" if r else "(SELECT run, user_id, 0 AS pending, 0.0::DOUBLE AS error_since, 0 AS queries_since, 0 AS past_updates, 0 AS last_query, NULL::INTEGER AS last_update, NULL::DOUBLE AS feature FROM runs, rated WHERE false)"
    saved = f"(SELECT run, saved FROM saved_{r - 1})" if r else "(SELECT run, 0.0::DOUBLE AS saved FROM runs)"
    score = " ".join(f"WHEN '{p}' THEN CAST({sql.format(r=r)} AS DOUBLE)" for p, (_, sql) in POLICIES.items())
    return f"""
asked_{r} AS MATERIALIZED (
  SELECT runs.run, e.user_id, known, rating AS y_true, CASE WHEN known THEN coalesce(s.feature, 3.0) ELSE 3.0::DOUBLE END AS y_pred
  FROM rated e CROSS JOIN runs LEFT JOIN {before} s ON s.run = runs.run AND s.user_id = e.user_id WHERE e.step = {r}),
touched_{r} AS (SELECT run, user_id, sum(abs(y_pred - y_true)) AS err, count(*) AS q, count(*) FILTER (known) AS new FROM asked_{r} GROUP BY 1, 2),
merged_{r} AS MATERIALIZED (
  SELECT run, user_id, coalesce(pending, 0) + coalesce(new, 0) AS pending, coalesce(error_since, 0) + coalesce(err, 0) AS error_since,
    coalesce(queries_since, 0) + coalesce(q, 0) AS queries_since, coalesce(past_updates, 0) AS past_updates,
    CASE WHEN q IS NULL THEN last_query ELSE {r} END AS last_query, last_update, feature
  FROM {before} s FULL JOIN touched_{r} USING (run, user_id)),
ranked_{r} AS (
  SELECT m.run, m.user_id, row_number() OVER (PARTITION BY m.run ORDER BY CASE policy {score} END DESC NULLS LAST, m.user_id) AS place,
    count(*) OVER (PARTITION BY m.run) AS waiting FROM merged_{r} m JOIN runs USING (run) WHERE pending > 0),
counted_{r} AS (SELECT run, count(*) AS waiting FROM merged_{r} WHERE pending > 0 GROUP BY 1),
total_{r} AS (SELECT run, saved + budget AS saved, coalesce(waiting, 0) <= saved + budget AS fired
  FROM runs JOIN {saved} USING (run) LEFT JOIN counted_{r} USING (run) WHERE policy = 'batch'),
saved_{r} AS MATERIALIZED (SELECT run, CASE WHEN fired THEN 0.0 ELSE saved END AS saved FROM total_{r}),
chosen_{r} AS MATERIALIZED (
  SELECT k.run, k.user_id FROM ranked_{r} k JOIN runs USING (run) LEFT JOIN total_{r} f ON f.run = k.run
  WHERE CASE WHEN policy = 'batch' THEN f.fired WHEN budget IS NULL THEN true ELSE place <= floor({r + 1} * budget) - floor({r} * budget) END),
state_{r} AS MATERIALIZED (
  SELECT m.run, m.user_id, CASE WHEN c.run IS NULL THEN pending ELSE 0 END AS pending, CASE WHEN c.run IS NULL THEN error_since ELSE 0 END AS error_since,
    CASE WHEN c.run IS NULL THEN queries_since ELSE 0 END AS queries_since, past_updates + CASE WHEN c.run IS NULL THEN 0 ELSE pending END AS past_updates,
    last_query, CASE WHEN c.run IS NULL THEN last_update ELSE {r} END AS last_update, CASE WHEN c.run IS NULL THEN feature ELSE mean END AS feature
  FROM merged_{r} m LEFT JOIN chosen_{r} c ON c.run = m.run AND c.user_id = m.user_id
  LEFT JOIN (SELECT user_id, avg(rating) AS mean FROM rated WHERE known AND step <= {r} GROUP BY 1) a ON a.user_id = m.user_id)"""


def sweep_sql(select):
    values = ", ".join(f"({i}, '{p}', {'NULL' if b is None else b}::DOUBLE)" for i, (p, b) in enumerate(SWEEP))
    return f"""WITH {RATINGS}, runs AS (SELECT * FROM (VALUES {values}) AS v(run, policy, budget)),
rated AS MATERIALIZED (SELECT user_id, rating, year(ts) - (SELECT min(year(ts)) FROM ratings) AS step, item_id % 40 <> 0 AS known FROM ratings),{",".join(map(_round_sql, YEARS))},
asked AS ({" UNION ALL ".join(f"SELECT *, {r} AS round_no FROM asked_{r}" for r in YEARS)}),
updates AS ({" UNION ALL ".join(f"SELECT *, {r} AS round_no FROM chosen_{r}" for r in YEARS)})
{select}"""


@query("stream_maintain_sweep", sweep_sql("""SELECT policy, budget, round_no, count(*) AS n, count(*) FILTER (NOT known) AS unknown, round(avg(power(y_pred - y_true, 2)), 9) AS mse
FROM asked JOIN runs USING (run) GROUP BY 1, 2, 3"""))
def _(t):
    sq = F.pow(F.col("y_pred") - F.col("y_true"), 2)
    return swept(t).table("predictions").groupBy("policy", "budget", "round_no").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("known")).alias("unknown"), F.round(F.avg(sq), 9).alias("mse"))


@query("stream_maintain_report", sweep_sql("""SELECT e.policy, e.n, round(e.mse, 9) AS mse, coalesce(total_updates, 0) AS total_updates, last_time,
  round(e.mse - min(e.mse) FILTER (e.policy = 'round_robin all') OVER (), 9) AS above_bound,
  round(max(e.mse) FILTER (e.policy = 'round_robin 0.0') OVER (), 9) AS upper_bound
FROM (SELECT policy || ' ' || coalesce(CAST(budget AS VARCHAR), 'all') AS policy, count(*) AS n, avg(power(y_pred - y_true, 2)) AS mse FROM asked JOIN runs USING (run) GROUP BY 1) e
LEFT JOIN (SELECT policy || ' ' || coalesce(CAST(budget AS VARCHAR), 'all') AS policy, count(*) AS total_updates, max(round_no) AS last_time
  FROM updates JOIN runs USING (run) GROUP BY 1) u ON u.policy = e.policy"""))
def _(t):
    """Error and updates of every run of the sweep, between the run that refreshes nothing and the one that refreshes everything."""
    job = swept(t)
    named = F.concat_ws(" ", "policy", F.coalesce(F.col("budget").cast("string"), F.lit("all"))).alias("policy")
    predictions = job.table("predictions").select(named, "y_true", "y_pred")
    results = stage(Q.policy_results(predictions, job.table("updates").select(named, F.col("round_no").alias("time")), "policy"))
    limits = Q.bounds(results.select("policy", F.col("mse").alias("error")), "policy", "error", "round_robin 0.0", "round_robin all")
    rounded = lambda c: F.round(c, 9).alias(c)
    return results.join(limits, "policy").select(
        "policy", "n", rounded("mse"), F.coalesce("total_updates", F.lit(0)).alias("total_updates"), "last_time", rounded("above_bound"), rounded("upper_bound"))


@query("udf_window_last", f"""WITH {WINDOWS} SELECT key, end_rn, vals[24] AS last_value, round(list_max(vals) - list_min(vals), 6) AS spread FROM wins""")
def _(t):
    spread = U.window_function(lambda v: max(v) - min(v))
    return windows24(t).select("key", "end_rn", U.window_last("values").alias("last_value"), F.round(spread("values"), 6).alias("spread"))


@query("udaf_weighted_avg", """WITH k AS (SELECT event_type, value, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k, CASE WHEN event_id % 4 = 3 THEN -1 ELSE 1 END AS sign FROM events)
SELECT event_type, round(sum(value * k) / nullif(sum(k), 0), 7) AS weighted_avg,
  round(sum(value * k * sign) / nullif(sum(k * sign), 0), 7) AS after_retract FROM k GROUP BY event_type""")
def _(t):
    k = F.regexp_extract("props", "[0-9]+", 0).cast("double")
    sign = F.when(F.col("event_id") % 4 == 3, -1).otherwise(1)
    return t.events.groupBy("event_type").agg(
        F.round(U.weighted_average("value", k), 7).alias("weighted_avg"),
        F.round(U.retractable_average("value", k, sign), 7).alias("after_retract"),
    )


@query("udtf_window_fit", f"""WITH {WINDOWS}, e AS (SELECT key, end_rn, unnest(vals) AS v, unnest(range(24)) AS pos FROM wins)
SELECT key, end_rn, CAST(pos AS INTEGER) AS pos, v AS value FROM e WHERE v > 60""")
def _(t):
    high = lambda v: [(i, x) for i, x in enumerate(v) if x > 60]
    return U.window_fit(windows24(t), high, ["key", "end_rn"], "pos INT, value DOUBLE")


@query("map_records", """SELECT event_id, 'copy' AS kind, value FROM events WHERE event_type <> 'error'
UNION ALL SELECT event_id, 'big', value * 2 FROM events WHERE event_type <> 'error' AND value > 50""")
def _(t):
    def each(r):
        if r["event_type"] == "error":
            return
        yield {"event_id": r["event_id"], "kind": "copy", "value": r["value"]}
        if r["value"] > 50:
            yield {"event_id": r["event_id"], "kind": "big", "value": r["value"] * 2}

    return U.map_records(t.events.select("event_id", "event_type", "value"), each, "event_id LONG, kind STRING, value DOUBLE")
