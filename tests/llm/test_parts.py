"""Parts of the operators by themselves: exact splices, windows, rules, network gradients, formatted parts, the pipeline."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("freshness.llm.queries")
from freshness.llm import chat_format, decontaminate, html_text, jaccard_join, packing, quality_rules, text, token_counts, url_filter
from freshness.llm.components import connected_components
from freshness.llm.queries import tokenizer


def test_word_and_window_hashes(monkeypatch):
    random.seed(3)
    texts = [bytes(random.choice(b"ab \n\t\x0bc\xc3\xa9") for _ in range(random.randint(0, 90))) for _ in range(300)]
    known = {}
    for slab in (7, 64, 1 << 19):
        monkeypatch.setattr(text, "SLAB", slab)
        for t, (words, windows) in zip(texts, text.hashed(texts, 3)):
            w = t.split()
            assert len(words) == len(w) and len(windows) == max(0, len(w) - 2)
            for key, h in [*zip(w, words), *((tuple(w[i : i + 3]), h) for i, h in enumerate(windows))]:
                assert known.setdefault(key, h) == h
    assert len(set(map(int, known.values()))) == len(known)


def test_overlaps_are_resynchronised():
    model = token_counts.load(tokenizer("piece_bpe_32k.model"))
    random.seed(1)
    for alphabet in ("abc de\n", "   a", "漢字é🙂 x", "aaaa"):
        whole = "".join(random.choice(alphabet) for _ in range(4000))
        for chunk, overlap in ((200, 8), (64, 2), (1000, 64)):
            parts = list(token_counts.encode_long(model, whole, chunk, overlap))
            assert np.concatenate(parts).tolist() == model.encode([whole])[0]
    unbroken = "x" * 3000  # no boundary is proven, so the chunk grows to the whole text
    assert np.concatenate(list(token_counts.encode_long(model, unbroken, 100, 10))).tolist() == model.encode([unbroken])[0]


def test_word_encoder_equals_the_library():
    encoder = packing.WordEncoder(tokenizer("word_bpe_49k.json"), limit=50)
    random.seed(2)
    pieces = ["Hello,", "world's", "naïve", "É", "e\u0301t", "ΑΣ", "İx", "12a", "<|endoftext|>", "\u00a0", "a\u2003b", "漢字", "...!!", "don't", "ß", "µ", " ", "\n", "\t", "\x0b", "\x0c", "\x1c", "\x85"]
    for _ in range(300):
        t = "".join(random.choice(pieces) + random.choice(["", " ", "\n"]) for _ in range(12))
        got = np.frombuffer(b"".join(map(encoder.__getitem__, t.encode().split())), "<u4").tolist()
        assert got == encoder.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_word_encoder_tokenizes_a_part_once_and_remembers_few():
    encoder = packing.WordEncoder(tokenizer("word_bpe_49k.json"), limit=20)
    asked, tokenize = [], encoder.tokenize
    encoder.tokenize = lambda part: asked.append(part) or tokenize(part)
    same = ["Maison maison, MAISON. Maison;", None, "", " \t\x0b\x0cmaison, \r\n maison. ", "ÉTÉ été"]
    encoder.texts(pa.array(same))
    assert sorted(asked) == sorted(["maison", ",", ".", ";", "Ã©tÃ©"])
    random.seed(3)
    pieces = ["Hello,", "world's", "É", "e\u0301t", "J\u030c", "12a", "<|endoftext|>", "\u00a0", "a\u2003b", "漢字", "!!", "ß", "\x1c", "\x85", "y" * 70, ","]
    texts = same + ["".join(random.choice(pieces) + random.choice(["", " ", "\n"]) for _ in range(40)) for _ in range(60)]
    for kind in (pa.string(), pa.large_string()):
        found = encoder.texts(pa.array(texts, kind).slice(1))
        for t, ids in zip(texts[1:], found, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)
    assert len(encoder.parts) <= 20 and len(encoder.others) <= 20 and encoder.texts(pa.array([None, ""], pa.string())) == [b"", b""]


def test_a_worker_remembers_a_bounded_number_of_words():
    encoder = packing.encoder(tokenizer("word_bpe_49k.json"))
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(letters[i // 26**k % 26] for k in range(4)) for i in range(210_000)]
    for at in range(0, len(words), 70_000):
        encoder.texts(pa.array([" ".join(words[at : at + 70_000])]))
    assert 0 < len(encoder.parts) <= 200_000 and len(encoder.others) <= 200_000


def test_best_fit_takes_the_tightest_window():
    random.seed(4)
    lengths = np.array([random.randint(1, 99) for _ in range(400)])
    where, offset = packing.best_fit(lengths, 100)
    rooms, expected = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = [r for r in rooms if r >= lengths[i]]
        room = min(fits) if fits else 100
        if fits:
            rooms.remove(room)
        rooms.append(room - lengths[i])
        expected[i] = 100 - room
    assert all(offset[i] == v for i, v in expected.items())
    assert max(np.bincount(where, weights=lengths)) <= 100


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)], "a long, b long")
    assert {(r.node, r.component) for r in connected_components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (150, 100), (200, 100)}


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Small limits send the same texts through leaders, several groups and opened groups."""
    random.seed(5)
    monkeypatch.setattr(jaccard_join, "SALTED", 8)
    monkeypatch.setattr(jaccard_join, "STREAMED", 4)
    monkeypatch.setattr(jaccard_join, "HELD", 4096)
    from tests.llm.test_queries import brute_components

    texts = []
    for base in range(3):
        words = [f"w{base}_{i}" for i in range(60)]
        for _ in range(40):
            copy = list(words)
            for _ in range(random.randint(0, 2)):
                copy[random.randrange(len(copy))] = f"new{random.random()}"
            texts.append((len(texts) + 1, " ".join(copy)))
    found = jaccard_join.link_documents(spark.createDataFrame(texts, "doc_id long, text string"))
    from collections import Counter

    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == brute_components(texts)


def test_decontamination_in_parts(spark):
    docs = spark.createDataFrame([(1, "X! One, two three; four"), (2, "none here")], "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    items = spark.createDataFrame([(1, "one two"), (2, "three four"), (3, "absent words")], "item_id long, text string")
    for limit in (1 << 20, 40):
        r = {x.doc_id: x for x in decontaminate.scan(docs, items, max_bytes=limit).collect()}
        assert (r[1].scan.n_hit, r[1].scan["items"], r[2].scan.n_hit, r[1].n_words) == (4, ["1", "2"], 0, "clash")
        assert [(s.begin, s.end) for s in r[1].scan.spans] == [(3, 23)]


def test_rules_cover_and_prune():
    rng = np.random.default_rng(0)
    data = {"symbols_per_word": rng.random(900), "words": rng.random(900) * 100}
    bad = ((data["symbols_per_word"] > 0.8) | (data["words"] < 5)).astype(int)
    rules = quality_rules.learn_rules(data, bad)
    rejected = np.logical_or.reduce([r.mask(data) for r in rules.rules])
    assert (rejected == bad).mean() > 0.98 and not quality_rules.learn_rules(data, bad * 0).rules


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = html_text.BiLSTM()
    net.p = {k: v.astype(np.float64) + rng.standard_normal(v.shape) * 0.1 for k, v in net.p.items()}
    pages = [[html_text.Block(("body", "p"), "a b c", 0), html_text.Block(("nav", "a"), "x", 1)], [html_text.Block(("article",), "q w. e", 0)] * 3]
    f, y = html_text.features(pages), np.array([1, 0, 1, 1, 0.0])
    _, grads = net.gradients(f, y)
    for k, g in grads.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        net.p[k][at] += 1e-3
        up = net.gradients(f, y)[0]
        net.p[k][at] -= 2e-3
        down = net.gradients(f, y)[0]
        net.p[k][at] += 1e-3
        assert abs(g[at] - (up - down) / 2e-3) < 1e-4


def test_typed_parts(spark):
    rows = [(1, 0, "user", [("text", "look [IMG] <s>", None, None), ("image", None, "a.png", 12), ("document", None, "b.pdf", 2)]), (1, 1, "assistant", [("audio", None, "c.wav", 3)]), (2, 0, None, None)]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>").withColumn("body", F.lit("clash"))
    chats = chat_format.format_conversations(chat_format.format_turns(turns)).withColumn("turns", chat_format.read_turns(F.col("formatted")))
    got = {r.conv_id: r for r in chats.collect()}
    assert got[1].formatted == "<s>[INST]look [\\IMG] <\\s>[NEXT][IMG][NEXT][DOC][/INST][OUT][AUD]</s>"
    assert [tuple(a) for a in got[1].attachments] == [("image", "a.png"), ("document", "b.pdf"), ("audio", "c.wav")]
    assert got[1].expanded_tokens == 12 + 512 + 6 and got[2].formatted == "<s>[ROLE][/ROLE][END]"


def test_url_list_beyond_the_filter(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 50}.com/p{i}") for i in range(400)], "page_id long, url string").withColumn("rule", F.lit(1))
    listed = pages.where("page_id % 3 = 0")
    found = url_filter.judge_urls(pages, [], listed, max_blocks=1)  # one block for 134 urls: nearly all bits are set, the join decides
    assert {r.page_id for r in found.where("verdict = 'block'").collect()} == {i for i in range(400) if i % 3 == 0}


def test_pipeline(spark, folder, empty):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for name, apply in pipeline.STAGES[:-1]:
        after = pipeline.stage(apply(spark, docs, folder))
        assert after.columns == columns
        if name == "n-gram Jaccard join":
            linked = jaccard_join.link_documents(docs)
            assert after.where("doc_id is not null").count() == linked.where("doc_id is not null").select("component_id").distinct().count()
        if name == "benchmark decontamination":
            assert decontaminate.scan(after, spark.read.parquet(f"{folder}/benchmark.parquet")).where("scan.n_hit > 0").count() == 0
        assert 0 < after.count() <= kept
        docs, kept = after, after.count()
    packed = pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert pipeline.run(spark, empty).count() == 0


@pytest.mark.parametrize("page,texts", [
    ("<p data=it's>Long article text that doesn't end</p><p>next</p>", ["Long article text that doesn't end", "next"]),
    ("<p title='a > b' alt=\"c > d\">one</p>", ["one"]),
    ("<p title=\"open>two</p><p>three</p>", ["two", "three"]),
    ("<article><svg><p>four</p></article>", ["four"]),
    ("<p>five <svg><title>icon</title></svg>six</p>", ["five six"]),
    ("<p>area <math><mi>x</mi></math> of <object>seven</object></p>", ["area x of seven"]),
    ("<template><p>eight</p>", ["eight"]),
    ("<p>nine</p><script>a < b; '<p>no</p>'", ["nine"]),
])
def test_broken_pages_lose_no_text(page, texts):
    from freshness.llm.html_text import leaf_blocks

    assert [b.text for b in leaf_blocks(page)] == texts
