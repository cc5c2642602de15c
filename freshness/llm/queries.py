"""The dealt operators on their whole tables, with SQL twins where SQL can express the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from freshness.llm import chat_format, chosen_path, decontaminate, hard_negatives, html_text, jaccard_join, lm_score, packing, quality_knn, quality_rules, spelling, token_counts, url_filter
from freshness.llm.text import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- op1: URL filters

URL_RULES = [
    url_filter.rule("allow", "org/"), url_filter.rule("block", "example.org/es/"), url_filter.rule("block", "example.org/en/1"),
    url_filter.rule("allow", "com/fr/"), url_filter.rule("block", "com/de/"),
]
# Labels of hosts whose pages are listed: the list of canonical URLs is derived from `pages` itself and grows with it.
LISTED_LABELS = ["spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x"]

_FITS = " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r}'"
    for r in sorted(URL_RULES, key=lambda r: -len(str(r)))
)
_BLOCKING = ", ".join(f"'{r}'" for r in URL_RULES if r.verdict == "block")


@query("op1_url_filter", f"""
WITH rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
named AS (
  SELECT *, CASE WHEN host <> '' THEN concat(regexp_replace(host, '^(www|m)\\.', ''),
           regexp_replace(regexp_replace(path, '/+$', ''), '\\.html?$', ''),
           coalesce('?' || nullif(array_to_string(list_sort(list_filter(
             string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'),
             lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), '&'), ''), '')) END AS canonical
  FROM parsed),
listed AS (
  SELECT DISTINCT canonical FROM named WHERE list_has_any(string_split(host, '.'), {LISTED_LABELS})),
ruled AS (SELECT *, CASE {_FITS} END AS rule FROM named)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN CASE WHEN rule IN ({_BLOCKING}) THEN 'block' ELSE 'allow' END
            WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""")
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    labels = F.array(*[F.lit(x) for x in LISTED_LABELS])
    listed = pages.where(F.arrays_overlap(F.split(url_filter.host_of(F.col("url")), r"\."), labels)).select("url")
    return url_filter.judge_urls(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict")


# --- op2: token counts


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, tokenizer("piece_bpe_32k.model")).drop("text")


# --- op3: HTML extraction


@query("op3_html_extraction")
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages, html_text.fit_labeller(pages)).drop("html")


# --- op4: benchmark decontamination

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op4_decontamination", f"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
bw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
items AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS pattern
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM items),
grams AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS pattern
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
found AS (SELECT r, i, n, item FROM grams JOIN items USING (pattern, n)),
hits AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY 1),
lists AS (SELECT r, string_agg(item, ',' ORDER BY item) AS items, count(*) AS n_items FROM (SELECT DISTINCT r, item FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (r) LEFT JOIN lists USING (r)""")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = decontaminate.scan(docs, read(spark, sf_dir, "benchmark"))
    return scanned.select(
        "doc_id", "scan.n_words", "scan.n_hit", F.size("scan.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("scan.items", ","), 256).alias("items_sha256"), (F.col("scan.n_hit") > 0).alias("contaminated"))


# --- op5: quality classifier


@query("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_knn.fit_neighbours(docs, read(spark, sf_dir, "labels"), keep=fold("__id", 5) != 0)
    scored = quality_knn.score_documents(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


# --- op6: packing


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    pieces = packing.token_pieces(docs, tokenizer("word_bpe_49k.json"), end_id=2)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


# --- op7: n-gram Jaccard join


@query("op7_jaccard_join")
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


# --- op8: quality rules


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.fit_rules(docs, read(spark, sf_dir, "labels"), keep=fold("__id", 5) != 0)
    return quality_rules.judge(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


# --- op9: chat formatting

PROBE = "</s>[INST] ok [/INST]"
_CHAT = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
sized AS (
  SELECT *, length(regexp_replace(text, '{chat_format.ESCAPE}', '\1\\\2\3', 'g')) AS body,
         CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9
              ELSE 18 + length(regexp_replace(role, '{chat_format.ESCAPE}', '\1\\\2\3', 'g')) END AS marks
  FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(body + marks) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""


@query("op9_chat_format", _CHAT)
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"))
    turns = given.unionByName(probe).withColumn("parts", chat_format.text_part(F.col("text")))
    chats = chat_format.format_conversations(chat_format.format_turns(turns))
    read_back = chats.withColumns({"turns": chat_format.read_turns(F.col("formatted")), "loss": chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))})
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


# --- op10: language-model scores


@query("op10_lm_score")
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm_score.score_documents(docs, fold("doc_id", 7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


# --- op11: near duplicates


@query("op11_chosen_path")
def op11_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.link_near_copies(read(spark, sf_dir, "documents"))


# --- op12: hard negatives


@query("op12_hard_negatives", """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM pos JOIN scored n USING (anchor_id)
WHERE NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
QUALIFY rank <= 5""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


# --- op13: spelling variants

# crc32 from its table, one byte at a time; U+00C0..U+00FF are two bytes in UTF-8
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, {bytes}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))"""


@query("op13_spelling_variants", f"""
WITH RECURSIVE t AS (
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) GROUP BY 1, 2),
hashed AS (
  SELECT run, n, xor(4294967295, {_CRC.format(bytes="flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x) - 64] END))")}) AS h
  FROM runs, t),
made AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM hashed GROUP BY 1),
words AS (SELECT word, n, length(word) AS size FROM made WHERE n >= 3 AND length(word) >= 5),
cuts AS (SELECT word, n, size, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(size)) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b USING (size, i, rest) WHERE a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM near GROUP BY 1),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form, CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.next)
SELECT f.word, n, n_near, form, form_n, root FROM formed f JOIN chain c ON f.word = c.word WHERE c.next IS NULL""")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(spelling.vocabulary(read(spark, sf_dir, "documents")))
