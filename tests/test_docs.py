from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from freshness.functions import scalars as S
from freshness.operators import docs as D
from freshness.plans import catalog
from freshness.sources import io


def diff(spark, old, new):
    pairs = spark.createDataFrame([(7, old, new)], "doc LONG, old ARRAY<STRING>, new ARRAY<STRING>")
    return D.sentence_diff(pairs, "doc", "old", "new").collect()


def test_alignment_gives_both_texts_back(spark):
    old = ["The cat sat on the mat. ", "It was a warm day. ", "Nobody came. ", "End."]
    new = ["The cat sat on the red mat. ", "It was a warm day. ", "Someone else arrived quite late. ", "End."]
    rows = diff(spark, old, new)
    assert [r.sent_a for r in sorted((r for r in rows if r.pos_a is not None), key=lambda r: r.pos_a)] == old
    assert [r.sent_b for r in sorted((r for r in rows if r.pos_b is not None), key=lambda r: r.pos_b)] == new
    assert {(r.pos_a, r.pos_b, r.diff_type) for r in rows} == {(0, 0, "EDIT"), (1, 1, None), (2, None, "DELETE"), (None, 2, "INSERT"), (3, 3, None)}
    edit = next(r for r in rows if r.diff_type == "EDIT")
    assert (edit.sent_a_diffs, edit.sent_b_diffs) == ([], ["red"])
    # the cat sat on the red mat: 6 of 7 words, 4 of 6 pairs, 3 of 5 triples, 2 of 4 runs of four are in the old sentence
    assert edit.score == pytest.approx((6 / 7 * 4 / 6 * 3 / 5 * 2 / 4) ** 0.25)


def test_alignment_of_copies_moves_and_nothing(spark):
    one, two = "Alpha beta gamma delta epsilon. ", "Alpha beta gamma delta zeta. "
    rows = diff(spark, [one, one, "x"], ["x", one, two])
    assert {(r.pos_a, r.pos_b, r.diff_type) for r in rows} == {(0, 1, None), (1, 2, "EDIT"), (2, 0, None)}
    assert diff(spark, None, []) == []
    assert [(r.sent_a, r.diff_type) for r in diff(spark, [None], None)] == [("", "DELETE")]
    assert {r.diff_type for r in diff(spark, [one, one], [one, one])} == {None}


@pytest.mark.parametrize("old,new,gone,come", [
    ("The cat sat on the mat in the sun", "The cat sat on mat in the sun", ["the"], []),
    ("The cat sat on mat in the sun", "The cat sat on the mat in the sun", [], ["the"]),
    ("They said on that day that A met B", "They said on that day that B met A", ["met B"], ["B met"]),
    ("Go on and on and on and on now", "Go on and on and on now", ["and on"], []),
    ("He was here - on the first day", "He was here on the first day", [], []),
])
def test_repeated_and_moved_words_are_changes(spark, old, new, gone, come):
    (row,) = diff(spark, [old], [new])
    assert (row.diff_type, row.sent_a_diffs, row.sent_b_diffs) == ("EDIT", gone, come)


def test_contested_sentences_take_the_next_best_partner(spark):
    old = ["a b c d e f g", "a b c d e f k m", "a b c d e f k m p q r s"]
    new = ["a b c d e f h", "a b c d n o", "a b c d v w x y"]
    rows = diff(spark, old, new)
    frame = lambda s, pos: spark.createDataFrame([(7, i, x) for i, x in enumerate(s)], f"doc LONG, {pos} INT, _s STRING")
    scores = {(r.pos_a, r.pos_b): r.score for r in D.sentence_scores(frame(old, "pos_a"), frame(new, "pos_b"), "doc").collect() if r.score > 0.1}
    want = set()
    for i, j in sorted(scores, key=lambda p: (-scores[p], abs(p[0] - p[1]), *p)):
        if all(i != x and j != y for x, y in want):
            want.add((i, j))
    assert {(r.pos_a, r.pos_b) for r in rows if r.diff_type == "EDIT"} == want and len(want) == 3


def test_scores_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = lambda n: [" ".join(rng.choice(list("abc"), size=rng.integers(1, 12))) for _ in range(n)]
    old, new = texts(12), texts(12)
    frame = lambda s, pos: spark.createDataFrame([(1, i, x) for i, x in enumerate(s)], f"doc LONG, {pos} INT, _s STRING")
    got = {(r.pos_a, r.pos_b): r.score for r in D.sentence_scores(frame(old, "pos_a"), frame(new, "pos_b"), "doc").collect()}

    def grams(words, n):
        return Counter(zip(*[words[i:] for i in range(n)]))

    want = {}
    for i, a in enumerate(old):
        for j, b in enumerate(new):
            x, y = a.split(), b.split()
            share = [sum((grams(x, n) & grams(y, n)).values()) / max(1, len(y) - n + 1) for n in range(1, 5)]
            if min(share) > 0:
                want[i, j] = min(1, np.exp(1 - len(x) / len(y))) * np.prod(share) ** 0.25
    assert got.keys() == want.keys() and want
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_sentences_join_to_the_text(spark):
    texts = ["No separator", "One. Two.\nThree. ", "", "Dots... and. more.\n\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "text STRING").select("text", S.split_sentences("text").alias("s"))
    out = rows.select("text", F.array_join("s", "").alias("again"), S.sentence_offsets("s").alias("at"), "s", S.passage_arrays("s", 2).alias("p"))
    for r in out.collect():
        assert r.again == r.text
        assert all(r.text[a : a + len(x)] == x for a, x in zip(r["at"], r.s))
        assert r.p == [" ".join(r.s[i : i + 2]) for i in range(0, len(r.s), 2)]


@pytest.mark.parametrize("block", [3, 512])
def test_ranking_equals_brute_force(spark, block):
    rng = np.random.default_rng(8)
    make = lambda n, base: [(base + i, 1 if i % 3 else 2, [float(x) for x in rng.normal(size=4)]) for i in range(n)]
    q, p = make(11, 0), make(40, 1000)
    p.append((2000, 1, p[1][2]))  # an equal score: the lower id wins
    schema = "id LONG, doc LONG, v ARRAY<DOUBLE>"
    qs = spark.createDataFrame(q, schema).withColumnRenamed("id", "qid")
    ps = spark.createDataFrame(p, schema).withColumnRenamed("id", "pid")
    got = D.rank_passages(qs, ps, "doc", "qid", "pid", "v", 5, block).collect()
    want = set()
    for qid, doc, v in q:
        scored = sorted((-round(float(np.dot(v, w)), 6), pid) for pid, d, w in p if d == doc)
        want |= {(qid, pid, rank + 1) for rank, (_, pid) in enumerate(scored[:5])}
    assert {(r.qid, r.pid, r["rank"]) for r in got} == want


def test_markup_file_with_many_documents(spark, tmp_path):
    docs = [(str(i), f"http://x/{i}", f"T {i}", f"Body {i}.\nMore {i}.") for i in range(20)]
    text = "\n".join(f'<doc id="{a}" url="{b}" title="{c}">\n{d}\n</doc>' for a, b, c, d in docs)
    (tmp_path / "wiki_00").write_text(text + "\n")
    got = io.read_document_markup(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(docs)


def test_change_files_and_keyed_files(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "1.json").write_text('[\n {"revid": 2, "old_revid": 1, "title": "A",\n "pageid": 9}, {"revid": 3, "title": "B"}]')
    got = io.read_change_files(spark, str(tmp_path / "c")).select("revid", "old_revid", "title", "pageid").collect()
    assert sorted(map(tuple, got)) == [(2, 1, "A", 9), (3, None, "B", None)]
    (tmp_path / "k").mkdir()
    for key in (4, 7):
        (tmp_path / "k" / f"series_{key}.csv").write_text(f"value,is_anomaly\n{key}.5,0\n")
    rows = io.read_keyed_dir(spark, str(tmp_path / "k"), r"series_(\d+)\.csv", "value DOUBLE, is_anomaly INT").collect()
    assert sorted((r.key_id, r.value) for r in rows) == [("4", 4.5), ("7", 7.5)]


def test_pluggable_encoder(spark):
    rows = spark.createDataFrame([("ab",), ("abc",)], "t STRING")
    out = D.embed_passages(rows, "t", encoder=lambda texts: np.array([[len(x), 1.0] for x in texts])).collect()
    assert sorted(tuple(r.embedding) for r in out) == [(2.0, 1.0), (3.0, 1.0)]


def test_minute_index_before_the_epoch(spark):
    rows = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:01:30' AS a, TIMESTAMP_NTZ '2023-12-31 23:59:00' AS b")
    got = rows.select(S.minute_index("a", "2024-01-01").alias("a"), S.minute_index("b", "2024-01-01").alias("b")).first()
    assert (got.a, got.b) == (1, None)


def test_equal_sentences_are_not_written(spark, monkeypatch):
    """Only sentences without an equal are staged; the others come from the row of their document."""
    staged = []
    monkeypatch.setattr(D, "stage", lambda df, stage=D.stage: staged.append(stage(df)) or staged[-1])
    old = ["It was a warm day. ", "It was a warm day. ", "The cat sat on the mat. "]
    rows = diff(spark, old, ["The cat sat on the red mat. ", "It was a warm day. ", "It was a warm day. "])
    assert {(r.pos_a, r.pos_b) for r in rows} == {(0, 1), (1, 2), (2, 0)}
    assert staged and not any("warm" in str(df.collect()) for df in staged)


def test_spans_come_with_the_alignment(spark, tmp_path):
    """The registered query names the words that went and came; its twin repeats them, moved words and single copies too."""
    texts = ["It was late. One of them saw b c d e and f. " * 4 + "He said x y z w v to us. He said v x y z w to us. End.", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").write.parquet(str(tmp_path / "documents.parquet"))
    rows = catalog.QUERIES["sentence_diff"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = con.sql(catalog.ORACLES["sentence_diff"])
    place = lambda r: tuple(-1 if r[c] is None else r[c] for c in ("doc_id", "pos_a", "pos_b"))
    spans = lambda rs: sorted((*place(r), r["sent_a_diffs"], r["sent_b_diffs"]) for r in rs)
    want = spans([dict(zip(got.columns, r)) for r in got.fetchall()])
    assert spans(r.asDict() for r in rows) == want and any(r[3] for r in want) and any(r[4] for r in want)
