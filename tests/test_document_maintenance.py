import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshness.operators import priority as R
from freshness.operators.docs import retrieval_scores, retrieval_scores_by_document
from freshness.plans import maintained_docs as P
from freshness.session import stage_by
from freshness.streaming import maintenance as M
from freshness.streaming.documents import DocumentMaintenance

PAIRS = "question_id LONG, version LONG"
QUESTIONS = "question_id LONG, vector ARRAY<DOUBLE>, answer STRING"
PASSAGES = "revid LONG, passage INT, vector ARRAY<DOUBLE>, text STRING"
EVENTS = "ts LONG, doc_id LONG, revid LONG, ask_id LONG, question_id LONG, init_revid LONG"


@pytest.fixture(scope="module")
def corpus():
    """Six documents with four revisions of up to 13 passages (one has none) and three questions each, equal scores included."""
    rng = np.random.default_rng(4)
    vector = lambda: [float(x) for x in rng.integers(0, 3, 4)]
    size = lambda r: 0 if r == 9 else 13 if r == 5 else 1 + r % 4
    passages = [(r, p, vector(), " ".join(f"w{x}" for x in rng.integers(0, 9, 6))) for r in range(24) for p in range(size(r))]
    questions = [(q, vector(), None if q == 4 else f"w{rng.integers(0, 9)}") for q in range(18)]
    return questions, passages


def plain_scores(corpus, question, version):
    _, q, answer = corpus[0][question]
    held = sorted((-float(np.dot(q, v)), p, t) for r, p, v, t in corpus[1] if r == version)
    hits = [int(answer is not None and answer in t) for _, _, t in held]
    return tuple(max(hits[:k], default=0) for k in (1, 5, 10)) + (len(held),)


def tables(spark, corpus):
    return spark.createDataFrame(corpus[0], QUESTIONS), spark.createDataFrame(corpus[1], PASSAGES)


def test_scores_equal_a_plain_loop(spark, corpus):
    pairs = [(q, r) for q in range(18) for r in (4 * (q // 3) + i for i in range(4))] + [(0, 99)]
    out = retrieval_scores(spark.createDataFrame(pairs, PAIRS), *tables(spark, corpus)).collect()
    assert len(out) == len(pairs)
    for r in out:
        assert (r.top1, r.top5, r.top10, r.doc_size) == plain_scores(corpus, r.question_id, r.version), r
    empty = retrieval_scores(spark.createDataFrame([], PAIRS), *tables(spark, corpus))
    assert empty.columns == ["question_id", "version", "top1", "top5", "top10", "doc_size"] and empty.isEmpty()


def batches(rounds=5):
    """Edits back and forth between revisions, questions of all documents; document 5 is not held, round 3 has no edits."""
    rng = np.random.default_rng(8)
    out, ts = [], 0
    for b in range(rounds):
        rows = []
        for _ in range(24):
            ts += 1
            d = int(rng.integers(0, 6)) if ts % 3 else 0
            start = None if d == 5 else 4 * d
            if b != 3 and rng.random() < 0.4:
                rows.append((ts, d, 4 * d + int(rng.integers(1, 4)), None, None, start))
            else:
                rows.append((ts, d, None, ts, 3 * d + int(rng.integers(0, 3)), start))
        out.append(rows)
    return out


RUNS = [M.Run("total_error", 1.5, lambda r: R.total_error()), M.Run("query_proportional", 1.0, lambda r: R.query_proportional()),
        M.Run("max_pending", 2.0, lambda r: R.max_pending()), M.Run("batch", 2.0), M.Run("none", 0.0, lambda r: R.max_pending()),
        M.Run("all", M.EVERYTHING, lambda r: R.max_pending())]


def plain_run(corpus, run, rounds):
    """(answers, updates) of one run, by dictionaries."""
    version, newest, pending, error, asked, saved = {}, {}, {}, {}, {}, 0.0
    answers, updates = [], []
    by = {"total_error": error, "query_proportional": asked, "max_pending": pending, "none": pending, "all": pending}
    for b, rows in enumerate(rounds):
        for ts, d, revid, _, _, start in rows:
            if revid is not None and start is not None:
                newest[d], pending[d] = revid, pending.get(d, 0) + 1
        waiting = [d for d, n in pending.items() if n]
        if run.policy == "batch":
            saved += run.budget
            fired = len(waiting) <= saved
            chosen, saved = (waiting, 0.0) if fired else ([], saved)
        elif run.budget is M.EVERYTHING:
            chosen = waiting
        else:
            allowed = math.floor((b + 1) * run.budget) - math.floor(b * run.budget)
            chosen = sorted(waiting, key=lambda d: (-by[run.policy].get(d, 0), d))[:allowed]
        for d in chosen:
            version[d], pending[d], error[d], asked[d] = newest[d], 0, 0, 0
            updates.append((b, d))
        for ts, d, revid, ask, q, start in rows:
            if ask is None:
                continue
            if start is None:
                answers.append((b, ask, None, None, None, None, None, None))
                continue
            v = version.get(d, start)
            found = plain_scores(corpus, q, v)
            answers.append((b, ask, v, v == newest.get(d, start)) + found)
            error[d], asked[d] = error.get(d, 0) + 1 - found[0], asked.get(d, 0) + 1
    return sorted(answers), sorted(updates)


def run_job(spark, folder, corpus, rounds, **options):
    job = DocumentMaintenance(spark, folder, RUNS, *tables(spark, corpus), **options)
    for b, rows in enumerate(rounds):
        job.run_batch(spark.createDataFrame(rows, EVENTS), b)
    return job


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory, corpus):
    """A job that never compacts, and the pairs it scored."""
    scored = []

    def score(pairs, questions, passages):
        scored.extend((r.question_id, r.version) for r in pairs.collect())
        return retrieval_scores(pairs, questions, passages)

    return run_job(spark, str(tmp_path_factory.mktemp("plain")), corpus, batches(), compact_every=100, score=score), scored


def test_every_run_equals_the_loop_and_no_pair_is_scored_twice(plain, corpus):
    job, scored = plain
    rounds = batches()
    answers, updates = job.table("predictions").collect(), job.table("updates").collect()
    for run in RUNS:
        want_answers, want_updates = plain_run(corpus, run, rounds)
        mine = [r for r in answers if r.policy == run.policy]
        got = sorted((r.round_no, r.ask_id, r.version, r.is_fresh, r.top1, r.top5, r.top10, r.doc_size) for r in mine)
        assert got == want_answers, run.policy
        assert sorted((r.round_no, r.doc_id) for r in updates if r.policy == run.policy) == want_updates, run.policy
    used = {(r.question_id, r.version) for r in answers if r.version is not None}
    assert len(scored) == len(set(scored)) and set(scored) == used


def test_compaction_and_a_repeated_round_change_nothing(spark, tmp_path, corpus, plain):
    plain, rounds = plain[0], batches()
    rows = lambda job: sorted(map(str, job.table("predictions").collect()))
    job = run_job(spark, str(tmp_path / "b"), corpus, rounds, compact_every=2)
    assert rows(job) == rows(plain)
    # a restarted job repeats a round and knows the logs from their folders alone
    again = DocumentMaintenance(spark, str(tmp_path / "b"), RUNS, *tables(spark, corpus), compact_every=2)
    again.run_batch(spark.createDataFrame(rounds[4], EVENTS), 4)
    assert rows(again) == rows(plain)
    # the base after round 3 holds the results of revisions in force only
    force = {r.version for r in plain.table("predictions").where("round_no <= 3 and version is not null").select("version").distinct().collect()}
    held = spark.read.parquet(str(tmp_path / "b" / "scores" / "base=000003"))
    features = plain._log("features", ["run", "doc_id"], 3).collect()
    published = {r.feature for r in features}
    many = {d: sum(r.doc_id == d for r in features) for d in range(6)}
    now = published | {4 * d for d in range(5) if many[d] < len(RUNS)}
    assert {r.version for r in held.select("version").collect()} == force & now
    assert held.count() < plain._memo(3).count()


def test_a_round_without_rows(spark, tmp_path, corpus):
    job = run_job(spark, str(tmp_path / "a"), corpus, [[], batches(1)[0], []])
    assert job.table("predictions").where("round_no <> 1").isEmpty()
    assert job.table("predictions").count() == len(RUNS) * sum(r[3] is not None for r in batches(1)[0])


def by_document(spark, questions, passages):
    """The flat tables as one row a document, in buckets."""
    q, p = spark.createDataFrame(questions, QUESTIONS), spark.createDataFrame(passages, PASSAGES)
    listed = lambda df, doc, name: df.groupBy(F.floor(doc).alias("doc_id")).agg(F.collect_list(F.struct(*df.columns)).alias(name))
    return stage_by(listed(q, F.col("question_id") / 3, "questions"), "doc_id"), stage_by(listed(p, F.col("revid") / 4, "passages"), "doc_id")


def test_scores_by_document_equal_the_flat_ones_and_shuffle_the_pairs_only(spark, corpus):
    pairs = spark.createDataFrame([(q, r, q // 3) for q in range(18) for r in (4 * (q // 3) + i for i in range(4))] + [(0, 99, 0), (70, 1, 0), (71, 400, 100)], PAIRS + ", doc_id LONG")
    cut = lambda version: F.filter("passages", lambda p: p["revid"] == version)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # the second corpus has rows that come twice
        for questions, passages in (corpus, (corpus[0] + corpus[0][:5], corpus[1] + corpus[1][:30])):
            out = retrieval_scores_by_document(pairs, *by_document(spark, questions, passages), cut)
            want = retrieval_scores(pairs, spark.createDataFrame(questions, QUESTIONS), spark.createDataFrame(passages, PASSAGES))
            assert out.dtypes == want.dtypes
            assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
            plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
            assert plan.count("Exchange hashpartitioning") == 1, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_questions_and_states_are_one_row_for_all_runs(spark, plain):
    job = plain[0]
    for b, rows in enumerate(batches()):
        asked = spark.read.parquet(f"{job.path}/asked/round={b:06d}")
        assert asked.count() == sum(r[3] is not None for r in rows)
        state = spark.read.parquet(f"{job.path}/state/round={b:06d}")
        assert state.count() == state.select("doc_id").distinct().count() and state.where(F.size("state") != len(RUNS)).isEmpty()


def test_passages_and_questions_of_odd_texts_in_one_pass(spark):
    """Equal to a plain loop, and no expression that goes through a text once a letter."""
    long = "".join(f"Sentence {i} é ß zz. " if i % 4 else f"line {i}.\n" for i in range(33))
    texts = {1: [long, "a. b"], 2: [""], 3: [". . . ", "é 中文. Zz "], 4: []}
    rows = spark.createDataFrame([*texts.items(), (5, None)], "doc_id LONG, texts ARRAY<STRING>")

    def sentences(text, number):
        marked = text.replace(".\n", ".\n|").replace(". ", ". |").split("|")
        return [s for i, s in enumerate(marked) if not number or i % 7 != number + 2]

    count = lambda t: [t.count(c) for c in P.LETTERS]
    for number in (0, 1, 4):
        made = rows.select("doc_id", P.doc_passages(F.col("doc_id") * 8 + number).alias("p"))
        assert "replace(" not in made._jdf.queryExecution().executedPlan().toString()
        got = {r.doc_id: r.p for r in made.collect()}
        assert got.pop(5) is None
        for d, mine in texts.items():
            cut = [(i // 10, " ".join(s[i : i + 10])) for s in (sentences(t, number) for t in mine) for i in range(0, len(s), 10)]
            assert [tuple(p) for p in got[d]] == [(i, [n * 1000 // max(len(t), 1) for n in count(t)], t) for i, t in cut]
    asked = spark.createDataFrame([((d * 8 + v) * 3 + k,) for d in texts for v in (0, 3) for k in range(3)] + [(None,)], "question_id LONG")
    made = P.doc_questions(asked, rows)
    assert "replace(" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: sorted((q.question_id, q.answer, q.vector) for q in r.questions) for r in made.collect()}
    assert got.keys() == texts.keys()
    for d, mine in texts.items():
        want = []
        for v in (0, 3):
            for k in range(3):
                answers = [s[k * len(s) // 3].strip(" ") for s in (sentences(t, v) for t in mine)]
                want += [((d * 8 + v) * 3 + k, a, count(a)) for a in answers]
        assert got[d] == sorted(want)
