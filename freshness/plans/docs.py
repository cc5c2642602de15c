"""Sections 2.1, 2.8 and 2.10: documents and retrieval."""

from pyspark.sql import functions as F

from freshness.functions.scalars import split_sentences
from freshness.operators import docs as D
from freshness.plans.joins import page_changes, CHANGES
from freshness.plans.registry import query
from freshness.plans.scalars import doc_passages
from freshness.plans.tables import REVISIONS


@query("extract_documents", r"""SELECT page_id, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
  md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', ' ', 'g'),
    '(?s)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS text_hash FROM pages""")
def _(t):
    pages = t.read("pages")
    return pages.select("page_id", "url", D.html_title("html").alias("title"), F.md5(D.strip_html("html")).alias("text_hash"))


@query("changed_sentences", f"""WITH {REVISIONS}, net AS (
  SELECT doc_id, sentence, sum(d) AS net FROM (
    SELECT doc_id, sentence, 1 AS d FROM old_sents UNION ALL SELECT doc_id, sentence, -1 FROM new_sents) GROUP BY ALL)
SELECT doc_id, md5(sentence) AS sentence, CAST(greatest(net, 0) AS BIGINT) AS removed, CAST(greatest(-net, 0) AS BIGINT) AS added FROM net WHERE net <> 0""")
def _(t):
    out = D.changed_sentences(t.old_sentences, t.new_sentences, "doc_id", "sentence")
    return out.withColumn("sentence", F.md5("sentence"))


@query("word_changes", f"""WITH {REVISIONS}, p AS (
  SELECT doc_id, pos, string_split(sentence, ' ') AS a, string_split(sentence || 'Revised. ', ' ') AS b FROM old_sents WHERE pos % 7 = 5)
SELECT doc_id, CAST(pos AS INTEGER) AS pos,
  md5(array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), '|')) AS removed,
  md5(array_to_string(list_sort(list_distinct(list_filter(b, lambda x: NOT list_contains(a, x)))), '|')) AS added FROM p""")
def _(t):
    edited = t.old_sentences.where("pos % 7 = 5")
    removed, added = D.word_changes(F.col("sentence"), F.concat("sentence", F.lit("Revised. ")))
    return edited.select("doc_id", "pos", F.md5(F.array_join(removed, "|")).alias("removed"), F.md5(F.array_join(added, "|")).alias("added"))


_GRAMS = """SELECT doc_id, pos, len(w) AS size, n, array_to_string(w[i : i + n - 1], ' ') AS gram, count(*) AS times FROM (
    SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, unnest([1, 2, 3, 4]) AS n FROM {0})) GROUP BY ALL"""


# Changed runs of words: what no run of equal words covers, longest run first (ties: the earlier in the old, then in the new
# sentence), then the same left and right of it. A box is a stretch of both sentences, `way` a diagonal of equal words.
_LONGEST = """SELECT doc_id, pos_a, pos_b, a_from, a_to, b_from, b_to,
    max(struct_pack(size := least(i_to, a_to, b_to - d) - greatest(i_from, a_from, b_from - d), i := -greatest(i_from, a_from, b_from - d), j := -d)) AS best
  FROM boxes JOIN ways USING (doc_id, pos_a, pos_b) WHERE least(i_to, a_to, b_to - d) > greatest(i_from, a_from, b_from - d) GROUP BY ALL"""
_SPANS = f"""edited AS MATERIALIZED (
  SELECT doc_id, pos_a, pos_b, score, x.sentence AS sent_a, y.sentence AS sent_b, x.w AS wa, y.w AS wb, least(len(x.w), len(y.w)) AS least_words
  FROM edits e JOIN rest_a x USING (doc_id) JOIN rest_b y USING (doc_id) WHERE x.pos = pos_a AND y.pos = pos_b),
headed AS (SELECT *, coalesce(list_min(list_filter(range(1, least_words + 1), lambda i: wa[i] <> wb[i])) - 1, least_words) AS head FROM edited),
tailed AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least_words - head + 1), lambda i: wa[len(wa) + 1 - i] <> wb[len(wb) + 1 - i])) - 1, least_words - head) AS tail FROM headed),
middle AS MATERIALIZED (SELECT doc_id, pos_a, pos_b, wa[head + 1 : len(wa) - tail] AS a, wb[head + 1 : len(wb) - tail] AS b FROM tailed),
met AS (
  SELECT doc_id, pos_a, pos_b, i, j - i AS d FROM (SELECT doc_id, pos_a, pos_b, unnest(a) AS word, unnest(range(1, len(a) + 1)) AS i FROM middle)
  JOIN (SELECT doc_id, pos_a, pos_b, unnest(b) AS word, unnest(range(1, len(b) + 1)) AS j FROM middle) USING (doc_id, pos_a, pos_b, word)),
ways AS MATERIALIZED (
  SELECT doc_id, pos_a, pos_b, d, min(i) AS i_from, max(i) + 1 AS i_to
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, pos_a, pos_b, d ORDER BY i) AS island FROM met) GROUP BY doc_id, pos_a, pos_b, d, island),
boxes AS (
  SELECT doc_id, pos_a, pos_b, 1::BIGINT AS a_from, len(a) + 1 AS a_to, 1::BIGINT AS b_from, len(b) + 1 AS b_to FROM middle
  UNION ALL
  SELECT doc_id, pos_a, pos_b, side.a_from, side.a_to, side.b_from, side.b_to FROM (
    SELECT doc_id, pos_a, pos_b, unnest([
      struct_pack(a_from := a_from, a_to := -best.i, b_from := b_from, b_to := -best.i - best.j),
      struct_pack(a_from := -best.i + best.size, a_to := a_to, b_from := -best.i - best.j + best.size, b_to := b_to)]) AS side
    FROM ({_LONGEST}))),
blocks AS (
  SELECT doc_id, pos_a, pos_b, -best.i AS i, -best.i - best.j AS j, best.size AS size FROM ({_LONGEST})
  UNION ALL SELECT doc_id, pos_a, pos_b, len(a) + 1, len(b) + 1, 0 FROM middle),
gaps AS (
  SELECT *, coalesce(lag(i + size) OVER same_pair, 1) AS i_from, coalesce(lag(j + size) OVER same_pair, 1) AS j_from FROM blocks
  WINDOW same_pair AS (PARTITION BY doc_id, pos_a, pos_b ORDER BY i, j)),
texts AS (
  SELECT doc_id, pos_a, pos_b, i, array_to_string(a[i_from : i - 1], ' ') AS ta, array_to_string(b[j_from : j - 1], ' ') AS tb FROM gaps JOIN middle USING (doc_id, pos_a, pos_b)),
spans AS (
  SELECT doc_id, pos_a, pos_b, string_agg(ta, '|' ORDER BY i) FILTER (regexp_matches(ta, '[a-zA-Z0-9]')) AS gone,
    string_agg(tb, '|' ORDER BY i) FILTER (regexp_matches(tb, '[a-zA-Z0-9]')) AS come FROM texts GROUP BY ALL)"""


@query("sentence_diff", f"""WITH RECURSIVE {REVISIONS},
a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sentence ORDER BY pos) AS nth FROM old_sents),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sentence ORDER BY pos) AS nth FROM new_sents),
both_sides AS (SELECT doc_id, sentence, a.pos AS pos_a, b.pos AS pos_b, regexp_extract_all(sentence, '[^\\x20\\x09-\\x0D]+') AS w
  FROM a FULL JOIN b USING (doc_id, sentence, nth)),
rest_a AS (SELECT doc_id, pos_a AS pos, sentence, w FROM both_sides WHERE pos_b IS NULL),
rest_b AS (SELECT doc_id, pos_b AS pos, sentence, w FROM both_sides WHERE pos_a IS NULL),
ga AS ({_GRAMS.format("rest_a")}), gb AS ({_GRAMS.format("rest_b")}),
counted AS (
  SELECT ga.doc_id, ga.pos AS pos_a, gb.pos AS pos_b, ga.size AS size_a, gb.size AS size_b, n, sum(least(ga.times, gb.times)) AS hits
  FROM ga JOIN gb USING (doc_id, n, gram) GROUP BY ALL),
scored AS (
  SELECT doc_id, pos_a, pos_b, round(exp(least(0, 1 - any_value(size_a) / any_value(size_b)) + sum(ln(hits / (size_b - n + 1))) / 4), 9) AS score
  FROM counted GROUP BY doc_id, pos_a, pos_b HAVING count(*) = 4),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, pos_a ORDER BY score DESC, abs(pos_a - pos_b), pos_a, pos_b) AS best_a,
         row_number() OVER (PARTITION BY doc_id, pos_b ORDER BY score DESC, abs(pos_a - pos_b), pos_a, pos_b) AS best_b
  FROM scored WHERE score > 0.1),
edits AS (SELECT * FROM ranked WHERE best_a = 1 AND best_b = 1),
{_SPANS},
found AS (
  SELECT doc_id, pos_a, pos_b, sentence AS sent_a, sentence AS sent_b, '' AS gone, '' AS come, NULL AS diff_type, NULL::DOUBLE AS score
  FROM both_sides WHERE pos_a IS NOT NULL AND pos_b IS NOT NULL
  UNION ALL
  SELECT doc_id, pos_a, pos_b, sent_a, sent_b, coalesce(gone, ''), coalesce(come, ''), 'EDIT', score FROM edited LEFT JOIN spans USING (doc_id, pos_a, pos_b)
  UNION ALL
  SELECT doc_id, pos, NULL, sentence, '', sentence, '', 'DELETE', NULL FROM rest_a x ANTI JOIN edits e ON x.doc_id = e.doc_id AND x.pos = e.pos_a
  UNION ALL
  SELECT doc_id, NULL, pos, '', sentence, '', sentence, 'INSERT', NULL FROM rest_b x ANTI JOIN edits e ON x.doc_id = e.doc_id AND x.pos = e.pos_b)
SELECT doc_id, CAST(pos_a AS INTEGER) AS pos_a, CAST(pos_b AS INTEGER) AS pos_b, sent_a, sent_b, gone AS sent_a_diffs, come AS sent_b_diffs,
  diff_type, round(score, 6) AS score FROM found""")
def _(t):
    out = D.sentence_diff(t.revisions, "doc_id", "old", "new")
    lists = {c: F.array_join(c, "|") for c in ("sent_a_diffs", "sent_b_diffs")}
    return out.withColumns({**lists, "score": F.round("score", 6)})


@query("sentence_spans")
def _(t):
    """The runs of words that went and came in each edited, removed or added sentence; SQL has no sequence match, tests use plain loops."""
    out = D.sentence_diff(t.revisions, "doc_id", "old", "new").where("diff_type is not null")
    lists = {c: F.array_join(c, "|") for c in ("sent_a_diffs", "sent_b_diffs")}
    return out.withColumns(lists).select("doc_id", "pos_a", "pos_b", "diff_type", *lists)


@query("revision_passages", f"""WITH {REVISIONS}, sides AS (
  SELECT doc_id AS revid, sentence, pos FROM old_sents UNION ALL SELECT doc_id + 1000000000, sentence, pos FROM new_sents)
SELECT revid, CAST(pos // 10 AS INTEGER) AS passage, md5(string_agg(sentence, ' ' ORDER BY pos)) AS hash FROM sides GROUP BY revid, pos // 10""")
def _(t):
    diffs = t.revisions.select(F.col("doc_id").alias("orig_id"), (F.col("doc_id") + 1_000_000_000).alias("new_id"), "old", "new")
    out = D.revision_passages(diffs)
    return out.select("revid", F.posexplode("passages").alias("passage", "p")).select("revid", "passage", F.md5("p").alias("hash"))


@query("embed_passages")
def _(t):
    out = D.embed_passages(doc_passages(t), "passage_text")
    return out.select("doc_id", "passage", F.posexplode("embedding").alias("i", "x")).where("x <> 0")


RANKED = """q AS (SELECT vec_id AS question_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 10 = 0),
p AS (SELECT vec_id AS passage_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 10 <> 0),
scored AS (SELECT q.label, question_id, passage_id, round(list_dot_product(q.e, p.e), 6) AS score FROM q JOIN p ON q.label = p.label),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, passage_id) AS rank FROM scored QUALIFY rank <= 10)"""


def ranked_passages(t):
    vectors = t.read("embeddings")
    questions = vectors.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "question_id")
    passages = vectors.where("vec_id % 10 <> 0").withColumnRenamed("vec_id", "passage_id")
    return D.rank_passages(questions, passages, "label", "question_id", "passage_id", "embedding", 10)


@query("rank_passages", f"WITH {RANKED} SELECT label, question_id, passage_id, score, CAST(rank AS INTEGER) AS rank FROM ranked")
def _(t):
    return ranked_passages(t)


@query("hit_at_k", f"""WITH {RANKED}, h AS (SELECT question_id, rank, CASE WHEN (question_id + passage_id) % 7 = 0 THEN 1 ELSE 0 END AS hit FROM ranked),
m AS (SELECT question_id, coalesce(max(hit) FILTER (rank <= 1), 0) AS t1, coalesce(max(hit) FILTER (rank <= 5), 0) AS t5, max(hit) AS t10 FROM h GROUP BY question_id)
SELECT round(avg(t1), 7) AS top1, round(avg(t5), 7) AS top5, round(avg(t10), 7) AS top10, count(*) AS n_questions FROM m""")
def _(t):
    hits = ranked_passages(t).withColumn("hit", ((F.col("question_id") + F.col("passage_id")) % 7 == 0).cast("int"))
    out = D.hit_at_k(hits, "question_id", "hit")
    return out.select(*[F.round(c, 7).alias(c) for c in ("top1", "top5", "top10")], "n_questions")


@query("check_streams", f"""WITH {CHANGES}, init AS (SELECT pageid AS doc_id, arg_min(revid, (ts, revid)) AS init_revid FROM changes WHERE ts < TIMESTAMP '2024-01-02' GROUP BY 1),
edits AS (SELECT pageid AS doc_id, revid, ts FROM changes WHERE ts < TIMESTAMP '2024-01-20'),
questions AS (SELECT revid AS question_id, pageid AS doc_id, revid, old_revid, ts, 'the' AS answer FROM changes),
known AS (
  SELECT q.*, init_revid, made IS NOT NULL AND made <= q.ts AS is_made, old_revid IS NOT DISTINCT FROM init_revid AS from_start
  FROM questions q JOIN init USING (doc_id)
  LEFT JOIN (SELECT doc_id, revid, min(ts) AS made FROM edits GROUP BY ALL) e ON q.doc_id = e.doc_id AND q.revid = e.revid)
SELECT 'missing_doc' AS rule, count(*) AS n FROM questions WHERE doc_id NOT IN (SELECT doc_id FROM init)
UNION ALL SELECT 'missing_edit', count(*) FROM known WHERE NOT is_made AND NOT from_start
UNION ALL SELECT 'missing_answer', count(*) FROM known k LEFT JOIN documents d ON d.doc_id = CASE WHEN is_made THEN k.revid ELSE init_revid END
  WHERE (is_made OR from_start) AND NOT coalesce(contains(d.text, answer), false)""")
def _(t):
    changes = page_changes(t).withColumnRenamed("pageid", "doc_id")
    early = changes.where("ts < TIMESTAMP_NTZ '2024-01-02'")
    init = early.groupBy("doc_id").agg(F.min_by("revid", F.struct("ts", "revid")).alias("init_revid"))
    edits = changes.where("ts < TIMESTAMP_NTZ '2024-01-20'").select("doc_id", "revid", "ts")
    questions = changes.select(F.col("revid").alias("question_id"), "doc_id", "revid", "old_revid", "ts", F.lit("the").alias("answer"))
    revisions = t.documents.select(F.col("doc_id").alias("revid"), split_sentences("text").alias("passages"))
    return D.check_streams(edits, questions, init, revisions)
