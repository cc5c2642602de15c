"""Section 2.7: column functions."""

from pyspark.sql import functions as F

from freshness.functions import scalars as S
from freshness.plans.joins import INDEXED, indexed
from freshness.plans.registry import query
from freshness.plans.tables import (
    DOC_SENTENCES, ITEM_MULTIPLIER, RATINGS, SENTENCES_SQL, USER_MULTIPLIER, RANK, factor_vector, factor_vector_sql,
)

IV, UV = factor_vector_sql("item_id", ITEM_MULTIPLIER), factor_vector_sql("user_id", USER_MULTIPLIER)
IDS = ["user_id", "item_id", "l_orderkey", "l_linenumber", "l_suppkey"]
IDS_SQL = ", ".join(IDS)


def rated_vectors(t):
    return t.ratings.select(
        *IDS, "rating", factor_vector("user_id", USER_MULTIPLIER).alias("u"), factor_vector("item_id", ITEM_MULTIPLIER).alias("m")
    )


@query("dot", f"WITH {RATINGS} SELECT {IDS_SQL}, round(list_dot_product({UV}, {IV}), 9) AS score FROM ratings")
def _(t):
    return rated_vectors(t).select(*IDS, F.round(S.dot_fixed("u", "m", RANK), 9).alias("score"))


@query("biased_rating", f"""WITH {RATINGS}, v AS (SELECT *, {UV} AS u, {IV} AS m FROM ratings)
SELECT {IDS_SQL}, round(least(greatest(3 * (list_dot_product(u[1:7], m[1:7]) + u[8] + m[8]), 1.0), 5.0), 9) AS score FROM v""")
def _(t):
    scaled = rated_vectors(t).withColumn("u", F.transform("u", lambda x: x * 3)).withColumn(
        "m3", F.concat(F.slice("m", 1, RANK - 1), F.array(F.element_at("m", -1) * 3))
    )
    return scaled.select(*IDS, F.round(S.biased_rating("u", "m3"), 9).alias("score"))


@query("parse_vector", """SELECT event_id, CAST(len(v) AS INTEGER) AS n, round(v[2], 4) AS second FROM (
  SELECT event_id, from_json('[1.5, ' || regexp_extract(props, '[0-9]+') || ', ' || value || ']', '["DOUBLE"]') AS v FROM events)""")
def _(t):
    text = F.concat_ws("", F.lit("[1.5, "), F.regexp_extract("props", "[0-9]+", 0), F.lit(", "), F.col("value").cast("string"), F.lit("]"))
    v = t.events.select("event_id", S.parse_vector(text).alias("v"))
    return v.select("event_id", F.size("v").alias("n"), F.round(F.get("v", F.lit(1)), 4).alias("second"))


SEASON = "[1.0, -0.5, 0.25, 2.0, 0.0, -1.5]::DOUBLE[]"
SEASON_VALUES = [1.0, -0.5, 0.25, 2.0, 0.0, -1.5]


def _season():
    return F.array(*[F.lit(x) for x in SEASON_VALUES])


@query("seasonal_at", f"""WITH {INDEXED}
SELECT event_id, round(({SEASON})[((rn - 1) // 2) % 6 + 1], 4) AS seasonal FROM indexed""")
def _(t):
    return indexed(t).select("event_id", F.round(S.seasonal_at(_season(), "rn", F.lit(1), 2), 4).alias("seasonal"))


@query("residual", f"""WITH {INDEXED}
SELECT event_id, round(value - 25.0 - ({SEASON})[(rn - 1) % 6 + 1], 4) AS residual FROM indexed""")
def _(t):
    return indexed(t).select("event_id", F.round(S.residual("value", F.lit(25.0), _season(), "rn", F.lit(1)), 4).alias("residual"))


@query("forecast_at", f"""WITH {INDEXED}
SELECT event_id, round(CASE WHEN rn - 20 BETWEEN 0 AND 5 THEN ({SEASON})[rn - 20 + 1] END, 4) AS forecast FROM indexed""")
def _(t):
    return indexed(t).select("event_id", F.round(S.forecast_at(_season(), "rn", F.lit(20)), 4).alias("forecast"))


@query("error_cols", """SELECT event_id, round(k - value, 4) AS diff, round(abs(k - value), 4) AS abs_error, round(power(k - value, 2), 4) AS sq_error,
  round(sqrt(abs(k - value)), 4) AS root_error FROM (SELECT event_id, value, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k FROM events)""")
def _(t):
    k = F.regexp_extract("props", "[0-9]+", 0).cast("double")
    return t.events.select("event_id", *[F.round(c, 4).alias(n) for n, c in S.error_cols("value", k).items()])


@query("epoch_to_time", "SELECT event_id, make_timestamp(1700000000000000 + event_id * 1000000) AS at FROM events")
def _(t):
    return t.events.select("event_id", S.epoch_to_time(F.col("event_id") + 1_700_000_000).cast("timestamp_ntz").alias("at"))


@query("parse_iso", "SELECT event_id, date_trunc('second', ts) AS at FROM events")
def _(t):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t.events.select("event_id", S.parse_iso(text).cast("timestamp_ntz").alias("at"))


@query("revision_ids", "SELECT event_id AS revid, user_id AS old_revid FROM events")
def _(t):
    name = F.concat_ws("", F.col("event_id").cast("string"), F.lit("_"), F.col("user_id").cast("string"), F.lit(".json"))
    return t.events.select(*S.revision_ids(name))


@query("safe_title", "SELECT page_id, translate(url || ' page', ' /', '--') AS title FROM pages")
def _(t):
    return t.read("pages").select("page_id", S.safe_title(F.concat("url", F.lit(" page"))).alias("title"))


@query("split_sentences", f"""WITH {DOC_SENTENCES}
SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5(sentence) AS hash FROM old_sents""")
def _(t):
    return t.old_sentences.select("doc_id", "pos", F.md5("sentence").alias("hash"))


@query("sentence_offsets", f"""WITH {DOC_SENTENCES}
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(coalesce(sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start_at
FROM old_sents""")
def _(t):
    sents = t.documents.select("doc_id", S.split_sentences("text").alias("s"))
    return sents.select("doc_id", F.posexplode(S.sentence_offsets("s")).alias("pos", "start_at"))


@query("has_alnum", f"""WITH {DOC_SENTENCES}
SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(sentence, '[a-zA-Z0-9]')) AS n_alnum FROM old_sents GROUP BY doc_id""")
def _(t):
    return t.old_sentences.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(S.has_alnum("sentence")).alias("n_alnum")
    )


PASSAGES = f"""{DOC_SENTENCES}, passages AS (
  SELECT doc_id, pos // 10 AS passage, string_agg(sentence, ' ' ORDER BY pos) AS passage_text FROM old_sents GROUP BY ALL)"""


def doc_passages(t):
    sents = S.split_sentences("text")
    return t.documents.select("doc_id", F.posexplode(S.passage_arrays(sents, 10)).alias("passage", "passage_text"))


@query("passages", f"WITH {PASSAGES} SELECT doc_id, CAST(passage AS INTEGER) AS passage, md5(passage_text) AS hash FROM passages")
def _(t):
    return doc_passages(t).select("doc_id", "passage", F.md5("passage_text").alias("hash"))


# A question asks for a benchmark text; its documents share a sentence with that text.
QUESTIONS = f"""{DOC_SENTENCES},
bench AS (SELECT item_id, text AS answer, unnest({SENTENCES_SQL.format(text='text')}) AS s FROM benchmark),
questions AS (
  SELECT DISTINCT item_id, answer, doc_id FROM bench JOIN old_sents ON trim(s) = trim(sentence) WHERE length(trim(s)) > 20)"""


def questions(t):
    bench = t.read("benchmark").select("item_id", F.col("text").alias("answer"), F.explode(S.split_sentences("text")).alias("s"))
    bench = bench.withColumn("s", F.trim("s")).where(F.length("s") > 20)
    sents = t.old_sentences.select("doc_id", F.trim("sentence").alias("s"))
    return sents.join(bench, "s").select("item_id", "answer", "doc_id").distinct()


@query("contains_answer", f"""WITH {QUESTIONS}, passages AS (
  SELECT doc_id, pos // 10 AS passage, string_agg(sentence, '' ORDER BY pos) AS passage_text FROM old_sents GROUP BY ALL)
SELECT item_id, q.doc_id, bool_or(contains(passage_text, answer)) AS found FROM questions q JOIN passages p ON q.doc_id = p.doc_id GROUP BY ALL""")
def _(t):
    docs = t.documents.select("doc_id", S.passage_arrays(S.split_sentences("text"), 10, "").alias("passages"))
    return questions(t).join(docs, "doc_id").select("item_id", "doc_id", S.contains_answer("passages", "answer").alias("found"))
