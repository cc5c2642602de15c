"""Section 2.1: sources and sinks. File formats are written from the tables first, then read back."""

import uuid

from pyspark.sql import functions as F

from freshness.plans.registry import query
from freshness.plans.tables import RATINGS, VERSIONS
from freshness.session import checkpoint_root
from freshness.sources import io as S


def fresh_folder(t, name):
    return f"{checkpoint_root(t.spark)}/{name}-{uuid.uuid4().hex}"


def plain_ratings(t):
    return t.ratings.select(
        F.col("user_id").cast("int"), F.col("item_id").cast("int").alias("movie_id"), F.round("rating", 6).alias("rating"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"),
    )


@query("read_ratings", f"WITH {RATINGS} SELECT CAST(user_id AS INTEGER) AS user_id, CAST(item_id AS INTEGER) AS movie_id, round(rating, 6) AS rating, CAST(epoch(ts) AS BIGINT) AS timestamp FROM ratings")
def _(t):
    path = fresh_folder(t, "ratings")
    plain_ratings(t).select(F.concat_ws("::", "user_id", "movie_id", "rating", "timestamp").alias("value")).write.text(path)
    return S.read_ratings(t.spark, path, "::")


@query("read_side_tables", """SELECT 'movie' AS kind, CAST(p_partkey AS INTEGER) AS movie_id, p_name AS text FROM part
UNION ALL SELECT 'tag', CAST(user_id AS INTEGER), event_type FROM events""")
def _(t):
    tags, movies = fresh_folder(t, "tags"), fresh_folder(t, "movies")
    t.events.select("user_id", F.col("user_id").alias("movie_id"), F.col("event_type").alias("tag"), "event_id").write.csv(tags, header=True)
    t.read("part").select("p_partkey", "p_name", "p_type").write.csv(movies, header=True)
    tag_rows, movie_rows = S.read_side_tables(t.spark, tags, movies)
    return movie_rows.select(F.lit("movie").alias("kind"), "movie_id", F.col("title").alias("text")).unionByName(
        tag_rows.select(F.lit("tag").alias("kind"), "movie_id", F.col("tag").alias("text"))
    )


@query("read_keyed_dir", "SELECT event_id, value, event_type AS key_id FROM events")
def _(t):
    path = fresh_folder(t, "keyed")
    t.events.select("event_id", "value", "event_type").write.partitionBy("event_type").csv(path, header=True)
    rows = S.read_keyed_dir(t.spark, f"{path}/event_type=*/*.csv", "event_type=([a-z]+)/", "event_id LONG, value DOUBLE")
    return rows


@query("read_trace_shards", """SELECT CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, CAST(user_id AS VARCHAR) AS key, value AS min_cpu, value AS max_cpu, value AS avg_cpu FROM events""")
def _(t):
    path = fresh_folder(t, "trace")
    value = F.col("value")
    t.events.select(F.unix_seconds(F.col("ts").cast("timestamp")), F.col("user_id").cast("string"), value, value.alias("b"), value.alias("c")).write.csv(path)
    return S.read_trace_shards(t.spark, f"{path}/*.csv")


@query("scan_keys", "SELECT user_id, ts, value FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 60)")
def _(t):
    keys = t.events.where("event_type = 'error' AND value > 60").select("user_id").distinct()
    return S.scan_keys(t.events, "user_id", ["ts", "value"], keys)


@query("top_keys_scan", """SELECT event_id, user_id, value FROM events WHERE user_id IN (
  SELECT user_id FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 10)""")
def _(t):
    return S.top_keys_scan(t.events.select("event_id", "user_id", "value"), "user_id", 10)


@query("distinct_keys_and_times", """SELECT 'key' AS kind, user_id AS v FROM (SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 25)
UNION ALL SELECT 'time', us FROM (SELECT DISTINCT epoch_us(ts) AS us FROM events)""")
def _(t):
    rows = t.events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    keys, times = S.distinct_keys_and_times(rows, "user_id", "us", 25)
    return keys.select(F.lit("key").alias("kind"), F.col("user_id").alias("v")).unionByName(
        times.select(F.lit("time").alias("kind"), F.col("us").alias("v"))
    )


@query("read_change_files", "SELECT event_id AS revid, user_id AS pageid, event_type AS title, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp FROM events")
def _(t):
    path = fresh_folder(t, "changes")
    record = F.struct(
        F.col("event_id").alias("revid"), F.col("event_type").alias("title"), F.col("user_id").alias("pageid"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
    )
    part = F.floor(F.col("event_id") / 2000).alias("part")
    lists = t.events.groupBy(part).agg(F.collect_list(record).alias("r"))
    lists.select("part", F.to_json("r").alias("value")).write.partitionBy("part").text(path)
    return S.read_change_files(t.spark, f"{path}/*/").select("revid", "pageid", "title", "timestamp")


@query("read_questions", "SELECT 'q' || item_id AS question, md5(text) AS answer, item_id AS doc_id FROM benchmark")
def _(t):
    path = fresh_folder(t, "questions")
    bench = t.read("benchmark")
    bench.select(
        F.concat(F.lit("q"), F.col("item_id").cast("string")), F.md5("text"), "item_id", F.lit("2024-01-01"), "item_id", "item_id"
    ).toDF("a", "b", "c", "d", "e", "f").write.csv(path, sep="\t")
    return S.read_questions(t.spark, path).select("question", "answer", "doc_id")


@query("read_document_markup", r"""SELECT CAST(page_id AS VARCHAR) AS id, url, md5(trim(regexp_replace(html, '\s+', ' ', 'g'))) AS hash FROM pages""")
def _(t):
    path = fresh_folder(t, "markup")
    body = F.trim(F.regexp_replace("html", r"\s+", " "))
    t.read("pages").select(
        F.format_string('<doc id="%s" url="%s" title="%s">\n%s\n</doc>', F.col("page_id"), F.col("url"), F.lit("t"), body).alias("value")
    ).write.text(path)
    return S.read_document_markup(t.spark, path).select("id", "url", F.md5("text").alias("hash"))


@query("json_records", "SELECT CAST(user_id AS VARCHAR) AS key, value AS cpu, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events")
def _(t):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts")
    raw = t.events.select(F.to_json(F.struct(F.col("user_id").cast("string").alias("key"), F.col("value").alias("cpu"), seconds)).cast("binary").alias("value"))
    return S.parse_json_records(raw, "key STRING, cpu DOUBLE, ts LONG")


@query("results_sink", "SELECT event_id, value, event_type AS policy, CAST(user_id % 3 AS INTEGER) AS updates FROM events")
def _(t):
    path = fresh_folder(t, "results")
    S.results_sink(t.events.select("event_id", "value", F.col("event_type").alias("policy"), (F.col("user_id") % 3).cast("int").alias("updates")), path)
    return t.spark.read.parquet(path)


@query("qa_files_sink", "SELECT CAST(doc_id AS INTEGER) AS doc_id, lang AS ts, n_chars AS n FROM documents")
def _(t):
    path = fresh_folder(t, "qa")
    S.qa_files_sink(t.documents.select("n_chars", F.col("lang").alias("ts"), "doc_id").where("true"), path, ("ts",))
    return t.spark.read.csv(path, sep="\t", schema="n LONG, doc_id INT, ts STRING")


@query("lookup_feature", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS version_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS feature FROM events WHERE event_type = 'purchase' AND user_id = 7 GROUP BY user_id")
def _(t):
    return S.lookup_feature(t.versions, "user_id", 7, ["ts", "version_id"])


@query("scan_features", f"WITH {VERSIONS} SELECT user_id, arg_max(version_id, (ts, version_id)) AS version_id, max(ts) AS ts, arg_max(feature, (ts, version_id)) AS feature FROM versions GROUP BY user_id")
def _(t):
    return S.scan_features(t.versions, "user_id", ["ts", "version_id"])
