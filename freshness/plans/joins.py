"""Section 2.3: joins."""

from pyspark.sql import functions as F

from freshness.functions.scalars import split_sentences, passage_arrays
from freshness.operators import joins as J
from freshness.operators.ordered import day_slice, hour_slice, width_slice, with_row_number, with_running
from freshness.plans.registry import query
from freshness.plans.tables import ITEMS, RANK, RATINGS, READINGS, SENTENCES_SQL, USERS, VERSIONS, VIEWS

EPOCH = "2024-01-01 00:00:00"


def _minute(ts):
    start = F.lit(EPOCH).cast("timestamp_ntz").cast("timestamp")
    return F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(start)) / 60_000_000).cast("long")


def indexed(t):
    """Readings with their 1-based position per key."""
    return with_row_number(t.readings, "key", ["ts", "event_id"], hour_slice("ts"), "rn")


INDEXED = f"""{READINGS}, indexed AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS rn FROM readings)"""


@query("asof_left", f"""WITH {VIEWS}, {VERSIONS}
SELECT query_id, q.user_id, q.ts, q.y, v.ts AS feature_ts, v.feature
FROM views q ASOF LEFT JOIN versions v ON q.user_id = v.user_id AND q.ts >= v.ts""")
def _(t):
    return J.asof_left(t.views, t.versions, "user_id", "ts", "version_id", ["feature"])


@query("asof_inner", f"""WITH {VIEWS}, {VERSIONS}
SELECT query_id, q.user_id, q.ts, q.y, v.ts AS feature_ts, v.feature
FROM views q ASOF JOIN versions v ON q.user_id = v.user_id AND q.ts >= v.ts""")
def _(t):
    return J.asof_inner(t.views, t.versions, "user_id", "ts", "version_id", ["feature"])


# Time in whole hours, so that versions at the time of the query do occur.
HOURLY = f"""{VIEWS}, {VERSIONS},
hv AS (SELECT query_id, user_id, date_diff('hour', TIMESTAMP '1970-01-01', ts) AS hr FROM views),
hf AS (SELECT user_id, date_diff('hour', TIMESTAMP '1970-01-01', ts) AS hr, version_id, feature FROM versions),
hl AS (SELECT * FROM hf QUALIFY row_number() OVER (PARTITION BY user_id, hr ORDER BY version_id DESC) = 1)"""


@query("asof_strict", f"""WITH {HOURLY}
SELECT query_id, q.user_id, q.hr, v.hr AS feature_ts, v.version_id, v.feature
FROM hv q ASOF LEFT JOIN hl v ON q.user_id = v.user_id AND q.hr > v.hr""")
def _(t):
    views = t.views.select("query_id", "user_id", hour_slice("ts").alias("hr"))
    versions = t.versions.select("user_id", hour_slice("ts").alias("hr"), "version_id", "feature")
    return J.asof_strict(views, versions, "user_id", "hr", "version_id", ["version_id", "feature"], width_slice("hr", 24))


@query("asof_with_default", f"""WITH {VIEWS}, {VERSIONS},
init AS (SELECT user_id, avg(value) AS feature FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT query_id, q.user_id, q.ts, q.y, v.ts AS feature_ts,
       round(CASE WHEN v.ts IS NULL THEN i.feature ELSE v.feature END, 9) AS feature
FROM views q ASOF LEFT JOIN versions v ON q.user_id = v.user_id AND q.ts >= v.ts
LEFT JOIN init i ON q.user_id = i.user_id""")
def _(t):
    init = t.events.where("event_type = 'signup'").groupBy("user_id").agg(F.avg("value").alias("feature"))
    out = J.asof_with_default(t.views, t.versions, init, "user_id", "ts", "version_id", ["feature"])
    return out.withColumn("feature", F.round("feature", 9))


@query("attach_clock", """WITH clock AS (
  SELECT DISTINCT CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 60) AS BIGINT) AS minute FROM events)
SELECT event_id, minute, round(minute * 0.3::DOUBLE, 4) AS wall
FROM (SELECT event_id, CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 60) AS BIGINT) AS minute FROM events)
JOIN clock USING (minute)""")
def _(t):
    steps = t.events.select("event_id", _minute("ts").alias("minute"))
    clock = steps.select("minute").distinct().withColumn("wall", F.round(F.col("minute") * F.lit(0.3), 4))
    return J.attach_clock(steps, clock, "minute")


@query("join_oracle", """SELECT q.event_id, user_id AS key, ts, value, o.k AS oracle
FROM (SELECT * FROM events WHERE event_type = 'view') q
JOIN (SELECT user_id, ts, value, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events) o
USING (user_id, ts, value)""")
def _(t):
    keyed = t.events.withColumnRenamed("user_id", "key")
    oracle = keyed.select("key", "ts", "value", F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("oracle"))
    views = keyed.where("event_type = 'view'").select("event_id", "key", "ts", "value")
    return J.join_oracle(views, oracle, ["key", "ts", "value"])


@query("join_predictions", """SELECT q.event_id AS query_id, q.user_id AS key, q.value AS value_x,
  round(f.value * 0.9, 4) AS value_y, f.event_type AS source
FROM events q JOIN events f ON q.event_id = f.event_id AND q.user_id = f.user_id""")
def _(t):
    keyed = t.events.select(F.col("event_id").alias("query_id"), F.col("user_id").alias("key"), "value", "event_type")
    made = keyed.select("query_id", "key", F.round(F.col("value") * 0.9, 4).alias("value"), F.col("event_type").alias("source"))
    return J.join_predictions(keyed.drop("event_type"), made, ["query_id", "key"])


@query("only_known_items", f"""WITH {RATINGS}
SELECT user_id, item_id, ts, l_orderkey, l_linenumber, round(rating, 4) AS rating
FROM ratings WHERE ts >= TIMESTAMP '1995-02-01'
  AND item_id IN (SELECT item_id FROM ratings WHERE ts < TIMESTAMP '1995-02-01')""")
def _(t):
    train = t.ratings.where("ts < TIMESTAMP_NTZ '1995-02-01'")
    stream = t.ratings.where("ts >= TIMESTAMP_NTZ '1995-02-01'")
    out = J.only_known_items(stream, train, "item_id")
    return out.select("user_id", "item_id", "ts", "l_orderkey", "l_linenumber", F.round("rating", 4).alias("rating"))


@query("enrich_left", f"""WITH {RATINGS}
SELECT user_id, item_id, l_suppkey, ts, p_name AS title, s_name AS tag
FROM ratings LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON item_id = p_partkey
LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey""")
def _(t):
    titles = t.read("part").where("p_size > 10").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))
    tags = t.read("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("tag"))
    return J.enrich_left(t.ratings.select("user_id", "item_id", "l_suppkey", "ts"), titles, tags, "item_id", "l_suppkey")


@query("time_spine", """WITH errors AS (
  SELECT date_diff('hour', TIMESTAMP '2024-01-01', ts) AS step, count(*) AS n FROM events
  WHERE event_type = 'error' GROUP BY 1)
SELECT s.step, coalesce(n, 0) AS n
FROM (SELECT unnest(range(a, b + 1)) AS step FROM (SELECT min(step) AS a, max(step) AS b FROM errors)) s
LEFT JOIN errors e ON s.step = e.step""")
def _(t):
    start = day_slice(F.lit(EPOCH).cast("timestamp_ntz")) * 24
    errors = t.events.where("event_type = 'error'").groupBy((hour_slice("ts") - start).alias("step"))
    return J.time_spine(errors.agg(F.count(F.lit(1)).alias("n")), "step", "n")


@query("count_before", f"""WITH {VIEWS}, {VERSIONS},
clicks AS (SELECT user_id, ts FROM events WHERE event_type = 'click'),
last_update AS (
  SELECT query_id, q.user_id, q.ts, v.ts AS u_ts
  FROM views q ASOF LEFT JOIN versions v ON q.user_id = v.user_id AND q.ts >= v.ts)
SELECT query_id, l.user_id, l.ts,
  count(*) FILTER (c.ts <= u_ts) AS past, count(*) FILTER (c.ts <= l.ts AND (u_ts IS NULL OR c.ts > u_ts)) AS pending
FROM last_update l LEFT JOIN clicks c ON l.user_id = c.user_id AND c.ts <= l.ts GROUP BY ALL""")
def _(t):
    clicks = t.events.where("event_type = 'click'").select("user_id", "ts")
    return J.count_before(t.views.drop("y"), clicks, t.versions.select("user_id", "ts"), "user_id", "ts")


PLAN = f"""{INDEXED}, plan AS (
  SELECT key, s AS start_idx, s + 23 AS end_idx
  FROM (SELECT key, unnest(range(1, max(rn) - 22, 8)) AS s FROM indexed GROUP BY key HAVING max(rn) >= 24))"""


def fit_plan(t, size=24, slide=8):
    longest = t.readings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= size)
    starts = F.sequence(F.lit(1).cast("long"), F.col("n") - size + 1, F.lit(slide).cast("long"))
    return longest.select("key", F.explode(starts).alias("start_idx")).withColumn("end_idx", F.col("start_idx") + size - 1)


@query("plan_slices", f"""WITH {PLAN}
SELECT p.key, start_idx, end_idx, count(*) AS n, round(sum(value), 4) AS total
FROM plan p JOIN indexed i ON p.key = i.key AND i.rn BETWEEN start_idx AND end_idx GROUP BY ALL""")
def _(t):
    rows = J.plan_slices(fit_plan(t), indexed(t), "key", "start_idx", "end_idx", "rn")
    return rows.groupBy("key", "start_idx", "end_idx").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


CHANGES = """changes AS (
  SELECT event_id AS revid, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_revid,
         user_id AS pageid, ts FROM events)"""


def page_changes(t):
    """Events as page changes: the user is the page, the previous event the old revision."""
    base = t.events.select(F.col("event_id").alias("revid"), F.col("user_id").alias("pageid"), "ts")
    return with_running(base, "pageid", ["ts", "revid"], hour_slice("ts"), {"old_revid": ("previous", F.col("revid"))})


@query("revision_pairs", f"""WITH {CHANGES}
SELECT c.revid, c.old_revid, c.pageid, md5(n.text) AS new_hash, md5(o.text) AS old_hash
FROM changes c JOIN documents n ON n.doc_id = c.revid JOIN documents o ON o.doc_id = c.old_revid""")
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("revid"), "text")
    pairs = J.revision_pairs(page_changes(t).drop("ts"), docs)
    return pairs.select("revid", "old_revid", "pageid", F.md5("new_text").alias("new_hash"), F.md5("old_text").alias("old_hash"))


@query("title_ids", """SELECT v.title, v.n_views, e.page_id FROM
  (SELECT 'Page/' || user_id AS title, count(*) AS n_views FROM events WHERE event_type = 'view' GROUP BY 1) v
  JOIN (SELECT DISTINCT 'Page/' || user_id AS title, user_id AS page_id FROM events WHERE event_type = 'signup') e
  ON v.title = e.title""")
def _(t):
    titled = t.events.withColumn("title", F.concat(F.lit("Page/"), F.col("user_id").cast("string")))
    views = titled.where("event_type = 'view'").groupBy("title").agg(F.count(F.lit(1)).alias("n_views"))
    edits = titled.where("event_type = 'signup'").withColumnRenamed("user_id", "page_id")
    return J.title_ids(views, edits, "title", "page_id")


@query("policy_vs_reference", """WITH errs AS (
  SELECT event_type AS policy, date_diff('day', TIMESTAMP '2024-01-01', ts) AS day, avg(value) AS error
  FROM events GROUP BY ALL)
SELECT e.policy, e.day, round(e.error, 9) AS error, round(r.error, 9) AS reference_error,
       round(e.error - r.error, 9) AS difference
FROM errs e LEFT JOIN errs r ON e.day = r.day AND r.policy = 'error'""")
def _(t):
    start = day_slice(F.lit(EPOCH).cast("timestamp_ntz"))
    errs = t.events.groupBy(F.col("event_type").alias("policy"), (day_slice("ts") - start).alias("day"))
    out = J.policy_vs_reference(errs.agg(F.avg("value").alias("error")), "error", "day")
    return out.select("policy", "day", *[F.round(c, 9).alias(c) for c in ("error", "reference_error", "difference")])


@query("score_all_items", f"""WITH {ITEMS}, {USERS}
SELECT user_id, count(*) AS n_items, round(avg(list_dot_product(user_vec, item_vec)), 4) AS mean_score,
       round(avg(power(list_dot_product(user_vec, item_vec), 2)), 4) AS mean_sq_score
FROM users, items GROUP BY user_id""")
def _(t):
    out = J.score_all_items(t.users.select("user_id", "user_vec"), t.items, "user_vec", "item_vec", RANK)
    return out.select("user_id", "n_items", F.round("mean_score", 4).alias("mean_score"), F.round("mean_sq_score", 4).alias("mean_sq_score"))


# Document refresh plan: a purchase of user d at ts loads revision event_id into document d.
REFRESH = f"""{VERSIONS},
init AS (SELECT DISTINCT user_id AS doc_id, user_id AS revid FROM events),
revs AS (SELECT doc_id AS revid, CAST((len({SENTENCES_SQL.format(text='text')}) + 9) // 10 AS INTEGER) AS n_passages FROM documents)"""


def refresh_inputs(t):
    plan = t.versions.select(F.col("user_id").alias("doc_id"), "ts", F.col("version_id").alias("revid"))
    init = t.events.select(F.col("user_id").alias("doc_id"), F.col("user_id").alias("revid")).distinct()
    revisions = t.documents.select(
        F.col("doc_id").alias("revid"), passage_arrays(split_sentences("text"), 10).alias("passages")
    )
    return init, plan, revisions


@query("version_table", f"""WITH {REFRESH}
SELECT doc_id, ts, w.revid, n_passages, CAST(n_passages IS NULL AS INTEGER) AS missing
FROM (SELECT user_id AS doc_id, ts, version_id AS revid FROM versions
      UNION ALL SELECT doc_id, NULL, revid FROM init) w LEFT JOIN revs r ON w.revid = r.revid""")
def _(t):
    out = J.version_table(*refresh_inputs(t))
    n_passages = F.when(F.col("passages").isNotNull(), F.size("passages"))
    return out.select("doc_id", "ts", "revid", n_passages.alias("n_passages"), "missing")


@query("questions_on_docs", f"""WITH {REFRESH}, {VIEWS},
known AS (SELECT user_id, ts, version_id AS revid FROM versions WHERE version_id IN (SELECT revid FROM revs)),
cur AS (
  SELECT query_id, q.user_id AS doc_id, q.ts, v.ts AS feature_ts, coalesce(v.revid, q.user_id) AS revid
  FROM views q ASOF LEFT JOIN known v ON q.user_id = v.user_id AND q.ts >= v.ts)
SELECT query_id, doc_id, ts, feature_ts, cur.revid, n_passages, CAST(n_passages IS NULL AS INTEGER) AS missing
FROM cur LEFT JOIN revs ON cur.revid = revs.revid""")
def _(t):
    init, plan, revisions = refresh_inputs(t)
    questions = t.views.select("query_id", F.col("user_id").alias("doc_id"), "ts")
    out = J.questions_on_docs(questions, plan, init, revisions)
    return out.withColumn("n_passages", F.when(F.col("missing") == 0, F.size("passages"))).drop("passages")


@query("docs_with_edits", """SELECT doc_id, lang FROM documents
WHERE (lang, doc_id) IN (SELECT lang, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1)""")
def _(t):
    edits = t.documents.join(t.read("labels").where("quality = 1"), "doc_id").select("doc_id", "lang")
    return J.docs_with_edits(t.documents.select("doc_id", "lang"), edits, ["lang", "doc_id"])


@query("evaluate_plan", f"""WITH {INDEXED},
models AS (SELECT key, rn AS m_rn, value AS trend FROM indexed WHERE rn % 8 = 0),
x AS (SELECT i.*, m.m_rn, m.trend, i.rn - m.m_rn AS age FROM indexed i
      ASOF LEFT JOIN models m ON i.key = m.key AND i.rn > m.m_rn)
SELECT key, event_id, rn, round(value - trend - [0.5, -1.0, 0.25][age % 3 + 1]::DOUBLE, 4) AS pred_residual, trend AS pred_trend,
       round(CASE WHEN age IS NOT NULL THEN [0.5, -1.0, 0.25][age % 3 + 1]::DOUBLE END, 4) AS pred_seasonality, age AS pred_staleness FROM x""")
def _(t):
    rows = t.indexed.select("key", "event_id", "rn", "value")
    season = F.array(F.lit(0.5), F.lit(-1.0), F.lit(0.25))
    models = rows.where("rn % 8 = 0").select("key", "rn", "event_id", F.col("value").alias("trend"), season.alias("season"))
    out = J.evaluate_plan(rows, models, "key", "rn", "value", "event_id", width_slice("rn", 4096)).drop("value")
    return out.withColumn("pred_residual", F.round("pred_residual", 4)).withColumn(
        "pred_seasonality", F.round("pred_seasonality", 4)
    )


FORECAST_EVAL = f"""{INDEXED},
models AS (SELECT key, rn AS m_rn, value AS base FROM indexed WHERE rn % 8 = 0),
fe AS (
  SELECT i.key, i.event_id, i.rn, i.value, i.rn - coalesce(m_rn, 0) AS staleness,
         coalesce(base, 50.0) + 0.1 * (i.rn - coalesce(m_rn, 0)) AS y_pred
  FROM indexed i ASOF LEFT JOIN models m ON i.key = m.key AND i.rn >= m.m_rn)"""


def forecast_rows(t):
    """Readings with the stored forecast in force: value, y_pred, staleness."""
    rows = t.indexed.select("key", "event_id", "rn", "value")
    ahead = F.sequence(F.lit(0), F.lit(15))
    models = rows.where("rn % 8 = 0").select(
        "key", "rn", "event_id", F.transform(ahead, lambda i: F.col("value") + F.lit(0.1) * i).alias("forecast")
    )
    init = t.readings.select("key").distinct().select(
        "key", F.transform(ahead, lambda i: F.lit(50.0) + F.lit(0.1) * i).alias("forecast")
    )
    return J.forecast_eval(rows, models, init, "key", "rn", "event_id", width_slice("rn", 4096))


@query("forecast_eval", f"""WITH {FORECAST_EVAL}
SELECT key, event_id, rn, round(y_pred, 4) AS y_pred, staleness FROM fe""")
def _(t):
    out = forecast_rows(t)
    return out.select("key", "event_id", "rn", F.round("y_pred", 4).alias("y_pred"), "staleness")
