"""Documents: markup, revisions, sentence differences, passages, retrieval."""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from freshness.functions.scalars import contains_answer, passage_arrays
from freshness.operators.ordered import width_slice, with_row_number
from freshness.session import stage


def extract_documents(raw: DataFrame, text: str = "value") -> DataFrame:
    """`<doc id url title>body</doc>` blocks as rows. Each input row may hold several blocks."""
    block = r'(?s)<doc id="[^"]*" url="[^"]*" title="[^"]*">.*?</doc>'
    one = F.explode(F.regexp_extract_all(text, F.lit(block), 0)).alias("_b")
    head = r'(?s)<doc id="([^"]*)" url="([^"]*)" title="([^"]*)">\s*(.*?)\s*</doc>'
    fields = ["id", "url", "title", "text"]
    return raw.select(one).select(*[F.regexp_extract("_b", head, i + 1).alias(n) for i, n in enumerate(fields)])


def strip_html(html: str | Column) -> Column:
    """Text of a page: scripts, styles and tags removed, white space collapsed."""
    html = F.col(html) if isinstance(html, str) else html
    for tag in ("script", "style"):
        html = F.regexp_replace(html, f"(?s)<{tag}[^>]*>.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"[ \t\r\n]+", " "))


def html_title(html: str | Column) -> Column:
    return F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1)


def changed_sentences(old: DataFrame, new: DataFrame, doc: str, sentence: str) -> DataFrame:
    """Sentences that one version holds more often than the other: how many were removed and added."""
    both = old.select(doc, sentence, F.lit(1).alias("_d")).unionByName(new.select(doc, sentence, F.lit(-1).alias("_d")))
    net = both.groupBy(doc, sentence).agg(F.sum("_d").alias("_net")).where("_net <> 0")
    return net.select(
        doc, sentence, F.greatest("_net", F.lit(0)).alias("removed"), F.greatest(-F.col("_net"), F.lit(0)).alias("added")
    )


def word_changes(sent_a: Column, sent_b: Column) -> tuple[Column, Column]:
    """Words only in the old sentence, and words only in the new one, sorted."""
    a, b = F.split(sent_a, " "), F.split(sent_b, " ")
    return F.array_sort(F.array_except(a, b)), F.array_sort(F.array_except(b, a))


def _same_places(old: list[str], new: list[str]) -> list[int]:
    """For each old sentence the place of the new one that equals it, the n-th copy to the n-th copy; -1 without one."""
    places = {}
    for at, sentence in enumerate(new):
        places.setdefault(sentence, []).append(at)
    left = {sentence: iter(at) for sentence, at in places.items()}
    return [next(left.get(sentence, iter(())), -1) for sentence in old]


def same_places(old: Column, new: Column) -> Column:
    """`_same_places` of two lists without nulls."""

    def each(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_same_places(x, y) for x, y in zip(a, b)], dtype=object)

    return F.pandas_udf(each, "array<int>")(old, new)


def _words(sentence: str) -> Column:
    return F.regexp_extract_all(sentence, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def _runs(places: list[int], sentences: list[str]) -> dict[int, tuple[int, list[Counter]]]:
    """By place: words of the sentence and how often each run of 1 to 4 of them occurs."""
    out = {}
    for at, sentence in zip(places, sentences):
        words = re.findall(r"[^\x20\x09-\x0D]+", sentence)
        size, runs = out.get(at, (0, [Counter() for _ in range(4)]))
        for n, times in enumerate(runs):
            times.update(zip(*[words[i:] for i in range(n + 1)]))
        out[at] = max(size, len(words)), runs
    return out


def _shared(old: dict, new: dict) -> Iterator[tuple]:
    """(pos_a, pos_b, len_a, len_b, hits of the orders 1 to 4) of the sentences that share a run of four words."""
    holders = {}
    for at, (_, runs) in new.items():
        for run in runs[3]:
            holders.setdefault(run, []).append(at)
    for a, (len_a, mine) in old.items():
        for b in {b for run in mine[3] for b in holders.get(run, ())}:
            len_b, theirs = new[b]
            yield a, b, len_a, len_b, *[sum(min(k, y[run]) for run, k in x.items() if run in y) for x, y in zip(mine, theirs)]


def sentence_scores(old: DataFrame, new: DataFrame, doc: str, at_once: int = 256) -> DataFrame:
    """BLEU (orders 1 to 4, equal weights, new against old) of sentences of one document that share a run of four words.

    `old` (doc, pos_a, _s), `new` (doc, pos_b, _s). Without such a run the score is 0. The sentences of a document
    are shuffled once, as lists; its pairs are found `at_once` old sentences at a time.
    """
    a, b = [df.groupBy(doc).agg(F.collect_list(F.struct(pos, "_s")).alias(name)) for df, pos, name in ((old, "pos_a", "_a"), (new, "pos_b", "_b"))]
    starts = F.explode(F.sequence(F.lit(1), F.size("_a"), F.lit(at_once))).alias("_from")
    parts = a.join(b, doc).select(doc, "_a", "_b", starts).select(doc, F.slice("_a", F.col("_from"), at_once).alias("_a"), "_b")
    columns = ["pos_a", "pos_b", "len_a", "len_b", *[f"hits_{n}" for n in range(1, 5)]]

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, at_a, s_a, at_b, s_b in frame.itertuples(index=False):
                found = pd.DataFrame(_shared(_runs(at_a, s_a), _runs(at_b, s_b)), columns=columns)
                if len(found):
                    yield found.assign(**{doc: key})

    kind = a.schema[doc].dataType.simpleString()
    counts = parts.select(doc, "_a.pos_a", F.col("_a._s").alias("_s_a"), "_b.pos_b", F.col("_b._s").alias("_s_b")).mapInPandas(
        pairs, f"{doc} {kind}, " + ", ".join(f"{c} int" for c in columns))
    logs = sum((F.log(F.col(f"hits_{n}") / (F.col("len_b") - n + 1)) for n in range(1, 5)), F.lit(0.0))
    short = F.least(F.lit(0.0), 1 - F.col("len_a") / F.col("len_b"))
    return counts.select(doc, "pos_a", "pos_b", F.round(F.exp(short + logs / 4), 9).alias("score"))


def _changed(old: list[str], new: list[str]) -> tuple[list[str], list[str]]:
    """Runs of words that went and that came, by their place in the sequence, if they have a letter or digit."""
    old, new = list(old), list(new)
    head = next((i for i, (x, y) in enumerate(zip(old, new)) if x != y), min(len(old), len(new)))
    most = min(len(old), len(new)) - head
    tail = next((i for i in range(most) if old[-1 - i] != new[-1 - i]), most)
    a, b = old[head : len(old) - tail], new[head : len(new) - tail]
    steps = [s for s in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if s[0] != "equal"]
    runs = [" ".join(a[i:j]) for _, i, j, _, _ in steps], [" ".join(b[k:l]) for _, _, _, k, l in steps]
    return tuple([r for r in side if re.search("[a-zA-Z0-9]", r)] for side in runs)


def changed_runs(old: Column, new: Column) -> Column:
    """(gone, come) of two lists of words, as `_changed` gives them."""

    def each(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_changed(x, y) for x, y in zip(a, b)], columns=["gone", "come"])

    return F.pandas_udf(each, "gone array<string>, come array<string>")(old, new)


def best_pairs(scored: DataFrame, doc: str) -> DataFrame:
    """Pairs of sentences that are each other's best partner, then those of the sentences left, until none can be paired.

    `scored` (doc, pos_a, pos_b, score) is staged. Each round is one set of joins over the pairs that are left; the
    best pair of a document is always taken, and contested sentences in a chain need a round for each link.
    """
    better = F.struct("score", -F.abs(F.col("pos_a") - F.col("pos_b")), -F.col("pos_a"), -F.col("pos_b"))
    found, left = scored.limit(0), scored
    while not left.isEmpty():
        of_old = left.groupBy(doc, "pos_a").agg(F.max_by("pos_b", better).alias("pos_b"), F.max("score").alias("score"))
        of_new = left.groupBy(doc, "pos_b").agg(F.max_by("pos_a", better).alias("pos_a"))
        best = stage(of_old.join(of_new, [doc, "pos_a", "pos_b"]))
        found = found.unionByName(best)
        for side in ("pos_a", "pos_b"):
            left = left.join(best.select(doc, side), [doc, side], "left_anti")
        left = stage(left)
    return found


def sentence_diff(pairs: DataFrame, doc: str, old: str, new: str, least_score: float = 0.1) -> DataFrame:
    """One row per aligned sentence of each document's two versions.

    The n-th copy of a sentence is the same as the n-th copy in the other version, wherever it stands. Of the
    rest, an old and a new sentence that are each other's best partner among those not yet paired (by BLEU, then the
    nearer place, then the lower places) and score above `least_score` are an EDIT; other old ones are a DELETE, other
    new ones an INSERT. Returns doc, pos_a, pos_b, sent_a, sent_b, the runs of words that went and that came (a word
    that moves, or one copy of several, counts), diff_type (null: unchanged) and score (edits only).

    `doc` names one pair of versions and is not null. A null list is an empty version, a null sentence an empty one.
    """
    whole = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda s: F.coalesce(s, F.lit("")))
    placed = pairs.select(doc, whole(F.col(old)).alias("_a"), whole(F.col(new)).alias("_b"))
    placed = placed.withColumn("_at", same_places(F.col("_a"), F.col("_b")))
    # only sentences without an equal are written and shuffled; the equal ones come from the row of their document
    item = lambda side, pos, s: F.struct(F.lit(side).alias("side"), pos.alias("pos"), s.alias("_s"))
    alone = F.filter(F.transform("_at", lambda to, i: F.when(to < 0, item("a", i, F.get("_a", i)))), lambda x: x.isNotNull())
    free = F.array_except(F.when(F.size("_b") > 0, F.sequence(F.lit(0), F.size("_b") - 1)).otherwise(F.array().cast("array<int>")), "_at")
    rest = placed.select(doc, F.explode(F.concat(alone, F.transform(free, lambda i: item("b", i, F.get("_b", i))))).alias("_r"))
    rest = stage(rest.select(doc, "_r.*"))
    rest_a, rest_b = [rest.where(F.col("side") == x).select(doc, F.col("pos").alias(f"pos_{x}"), "_s") for x in "ab"]
    met = F.filter(F.transform("_at", lambda to, i: F.struct(i.alias("pos_a"), to.alias("pos_b"), F.get("_a", i).alias("_s"))), lambda x: x["pos_b"] >= 0)
    both = placed.select(doc, F.explode(met).alias("_r")).select(doc, "_r.*")
    scored = stage(sentence_scores(rest_a, rest_b, doc).where(F.col("score") > least_score))
    edits = stage(best_pairs(scored, doc))

    none = F.array().cast("array<string>")
    row = lambda sent_a, sent_b, gone, come, kind, score: [
        doc, "pos_a", "pos_b", sent_a.alias("sent_a"), sent_b.alias("sent_b"), gone.alias("sent_a_diffs"), come.alias("sent_b_diffs"),
        F.lit(kind).cast("string").alias("diff_type"), score.cast("double").alias("score")]
    s, blank, no_place, no_score = F.col("_s"), F.lit(""), F.lit(None).cast("int"), F.lit(None)
    same = both.select(*row(s, s, none, none, None, no_score))
    texts = edits.join(rest_a.withColumnRenamed("_s", "_a"), [doc, "pos_a"]).join(rest_b.withColumnRenamed("_s", "_b"), [doc, "pos_b"])
    runs = changed_runs(_words("_a"), _words("_b"))
    edited = texts.withColumn("_runs", runs).select(
        *row(F.col("_a"), F.col("_b"), F.col("_runs.gone"), F.col("_runs.come"), "EDIT", F.col("score")))
    gone = rest_a.join(edits.select(doc, "pos_a"), [doc, "pos_a"], "left_anti").withColumn("pos_b", no_place)
    come = rest_b.join(edits.select(doc, "pos_b"), [doc, "pos_b"], "left_anti").withColumn("pos_a", no_place)
    return same.unionByName(edited).unionByName(gone.select(*row(s, blank, F.array(s), none, "DELETE", no_score))).unionByName(
        come.select(*row(blank, s, none, F.array(s), "INSERT", no_score)))


def revision_passages(diffs: DataFrame, n: int = 10) -> DataFrame:
    """Passages of every revision named in (orig_id, new_id, old, new), each revision once."""
    old = diffs.select(F.col("orig_id").alias("revid"), F.col("old").alias("s"), F.lit(0).alias("_side"))
    new = diffs.select(F.col("new_id").alias("revid"), F.col("new").alias("s"), F.lit(1).alias("_side"))
    once = old.unionByName(new).groupBy("revid").agg(F.min_by("s", "_side").alias("s"))
    return once.select("revid", passage_arrays("s", n).alias("passages"))


def embed_passages(df: DataFrame, text: str, size: int = 64, encoder: Callable[[list[str]], np.ndarray] | None = None):
    """A vector per passage: hashed terms of unit length, or what `encoder` gives for a batch of texts."""
    if encoder is None:
        words = df.withColumn("_w", F.split(F.lower(text), r"\s+"))
        hashed = HashingTF(numFeatures=size, inputCol="_w", outputCol="_tf").transform(words)
        unit = Normalizer(inputCol="_tf", outputCol="_v").transform(hashed)
        return unit.withColumn("embedding", vector_to_array("_v")).drop("_w", "_tf", "_v")

    def encode(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for frame in frames:
            yield pd.Series([np.asarray(v, dtype=float) for v in encoder(frame.tolist())], dtype=object)

    return df.withColumn("embedding", F.pandas_udf(encode, T.ArrayType(T.DoubleType()))(text))


def _vector_blocks(df: DataFrame, doc: str, vec_id: str, vector: str, block: int, prefix: str) -> DataFrame:
    placed = with_row_number(df, doc, vec_id, width_slice(vec_id, 65_536), "_rn")
    packed = F.sort_array(F.collect_list(F.struct(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))))
    at = F.floor((F.col("_rn") - 1) / block).cast("long").alias(f"{prefix}_block")
    return placed.groupBy(doc, at).agg(packed.alias(prefix))


def rank_passages(questions, passages, doc: str, question_id: str, passage_id: str, vector: str, k: int, block: int = 512):
    """Per question the k best passages of its document by inner product (lower id on ties).

    Vectors are packed into blocks of `block`; each pair of a question block and
    a passage block of one document is one small matrix product that keeps k
    passages per question. A document with many passages becomes many pairs on
    many tasks, and only k rows per question and passage block are shuffled.
    """
    q = _vector_blocks(questions, doc, question_id, vector, block, "q")
    p = _vector_blocks(passages, doc, passage_id, vector, block, "p")
    blocks_of_doc = p.groupBy(doc).agg(F.max("p_block").alias("_last"))
    pairs = q.select(doc, "q_block").join(blocks_of_doc, doc).select(
        doc, "q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("p_block")
    )
    meet = pairs.join(p, [doc, "p_block"]).join(q, [doc, "q_block"])

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, qs, ps in zip(frame[doc], frame["q"], frame["p"]):
                q_ids, p_ids = np.array([r["id"] for r in qs]), np.array([r["id"] for r in ps])
                scores = np.round(np.stack([r["v"] for r in qs]) @ np.stack([r["v"] for r in ps]).T, 6)
                keep = min(k, len(p_ids))
                # stable sort: passages come in id order, so equal scores keep the lower id first
                top = np.argsort(-scores, axis=1, kind="stable")[:, :keep]
                yield pd.DataFrame(
                    {
                        doc: key, question_id: np.repeat(q_ids, keep), passage_id: p_ids[top].ravel(),
                        "score": np.take_along_axis(scores, top, axis=1).ravel(),
                    }
                )

    type_of = lambda df, c: df.schema[c].dataType.simpleString()
    shape = (
        f"{doc} {type_of(questions, doc)}, {question_id} {type_of(questions, question_id)}, "
        f"{passage_id} {type_of(passages, passage_id)}, score double"
    )
    candidates = meet.select(doc, "q", "p").mapInPandas(best, shape)
    per_question = W.partitionBy(question_id).orderBy(F.desc("score"), passage_id)
    return candidates.withColumn("rank", F.row_number().over(per_question)).where(F.col("rank") <= k)


def hit_at_k(ranked: DataFrame, question_id: str, hit: str, ks=(1, 5, 10)) -> DataFrame:
    """Share of questions with a hit among the first k passages, for each k."""
    per_question = ranked.groupBy(question_id).agg(
        *[F.max(F.when(F.col("rank") <= k, F.col(hit)).otherwise(0)).alias(f"top{k}") for k in ks]
    )
    return per_question.agg(*[F.avg(f"top{k}").alias(f"top{k}") for k in ks], F.count(F.lit(1)).alias("n_questions"))


def retrieval_scores(pairs: DataFrame, questions: DataFrame, passages: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """For each (question_id, version, ...): whether a passage with the answer is among the first k (`top1`, ...), and `doc_size`, the passages of the version.

    Passages (revid, passage, vector, text) go by inner product with the vector of questions (question_id, vector, answer), lower
    passage first on ties. Each task keeps the first max(ks) of a pair before rows are shuffled, without texts and vectors. A version without
    passages has no hits and size 0; a null answer is never hit.
    """
    asked = pairs.select("question_id", "version").join(questions.select("question_id", F.col("vector").alias("_q"), "answer"), "question_id")
    held = passages.select(F.col("revid").alias("version"), "passage", F.col("vector").alias("_p"), "text")
    score = F.aggregate(F.zip_with("_q", "_p", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    scored = asked.join(held, "version").select(
        "question_id", "version", "passage", score.alias("_score"), F.coalesce(F.contains("text", "answer"), F.lit(False)).cast("int").alias("_hit"))
    place = F.row_number().over(W.partitionBy("question_id", "version").orderBy(F.desc("_score"), "passage"))
    first = scored.withColumn("_place", place).where(F.col("_place") <= max(ks)).groupBy("question_id", "version").agg(
        *[F.max(F.when(F.col("_place") <= k, F.col("_hit")).otherwise(0)).alias(f"top{k}") for k in ks])
    sizes = held.groupBy("version").agg(F.count(F.lit(1)).alias("doc_size"))
    out = pairs.join(first, ["question_id", "version"], "left").join(sizes, "version", "left")
    nought = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(*pairs.columns, *[nought(f"top{k}") for k in ks], nought("doc_size"))


def retrieval_scores_by_document(pairs: DataFrame, questions: DataFrame, documents: DataFrame, cut: Callable[[Column], Column],
                                 ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """`retrieval_scores` of (question_id, version, doc_id, ...) where questions and texts are kept as one row a document.

    questions (doc_id, questions), a list of (question_id, vector, answer); documents (doc_id, ...), of which `cut(version)` makes the list of
    (passage, vector, text). The pairs go to the row of their document: with both tables in buckets by doc_id (`stage_by`) no
    text and no vector is shuffled, and passages are made only of versions that are asked for.
    """
    listed = pairs.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in pairs.columns if c != "doc_id"])).alias("_asked"))
    of_version = lambda v: F.struct(v.alias("version"), F.filter("_asked", lambda a: a["version"] == v).alias("asked"))
    met = listed.join(questions, "doc_id", "left").join(documents, "doc_id", "left")
    each = met.select("*", F.explode(F.transform(F.array_distinct("_asked.version"), of_version)).alias("_v"))
    held = each.select("doc_id", "questions", "_v", cut(F.col("_v.version")).alias("_p"))
    one = held.select("doc_id", "questions", "_p", F.explode("_v.asked").alias("_a"))

    score = lambda q, p: F.aggregate(F.zip_with(q["vector"], p["vector"], lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    hit = lambda q, p: F.coalesce(F.contains(p["text"], q["answer"]), F.lit(False)).cast("int")
    rated = lambda q: F.transform("_p", lambda p: F.struct(score(q, p).alias("score"), (-p["passage"]).alias("earlier"), hit(q, p).alias("hit")))
    mine = F.filter("questions", lambda q: q["question_id"] == F.col("_a.question_id"))
    placed = F.sort_array(F.flatten(F.transform(mine, rated)), asc=False)
    first = F.coalesce(F.array_position(F.transform(placed, lambda r: r["hit"]), 1), F.lit(0)).alias("_first")
    size = F.when(F.col("_p").isNotNull(), F.size("_p")).otherwise(0).cast("long").alias("doc_size")
    out = one.select("doc_id", "_a.*", first, size)
    return out.select(*pairs.columns, *[F.col("_first").between(1, k).cast("int").alias(f"top{k}") for k in ks], "doc_size")


def check_streams(edits: DataFrame, questions: DataFrame, init: DataFrame, revisions: DataFrame) -> DataFrame:
    """Number of questions that break each rule of a consistent stream.

    edits (doc_id, revid, ts), questions (question_id, doc_id, revid, old_revid,
    ts, answer), init (doc_id, init_revid), revisions (revid, passages).
    """
    asked = questions.select("question_id", "doc_id", "revid", "old_revid", "ts", "answer")
    no_doc = asked.join(init, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    first_edit = edits.groupBy("doc_id", "revid").agg(F.min("ts").alias("_made"))
    known = asked.join(init, "doc_id").join(first_edit, ["doc_id", "revid"], "left")
    made = F.col("_made").isNotNull() & (F.col("_made") <= F.col("ts"))
    from_start = F.col("old_revid").eqNullSafe(F.col("init_revid"))
    no_edit = known.where(~made & ~from_start).agg(F.count(F.lit(1)).alias("n"))
    usable = known.where(made | from_start).withColumn("used", F.when(made, F.col("revid")).otherwise(F.col("init_revid")))
    texts = usable.join(revisions.withColumnRenamed("revid", "used"), "used", "left")
    lost = ~F.coalesce(contains_answer("passages", "answer"), F.lit(False))
    no_answer = texts.where(lost).agg(F.count(F.lit(1)).alias("n"))
    out = None
    for rule, part in (("missing_doc", no_doc), ("missing_edit", no_edit), ("missing_answer", no_answer)):
        part = part.select(F.lit(rule).alias("rule"), "n")
        out = part if out is None else out.unionByName(part)
    return out
