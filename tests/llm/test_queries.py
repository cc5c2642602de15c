"""The dealt queries on small tables with odd rows, against SQL or brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

pytest.importorskip("freshness.llm.queries")
from freshness.llm.queries import ORACLES, QUERIES, tokenizer
from scripts.check_oracle import rows_of


def rows(spark, name, folder):
    return QUERIES[name](spark, folder).collect()


def in_fold(doc_id, modulus, remainder):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == remainder


def words(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, folder)
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()], order) == rows_of(columns, want.fetchall(), order)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    found = rows(spark, name, empty)
    assert len(found) == (1 if name.startswith("op9") else 0)


def test_token_counts(spark, folder, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    want = Counter((d, len((t or "").encode()), n, n > 4096) for (d, t), n in zip(texts, map(len, model.encode([t or "" for _, t in texts]))))
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows(spark, "op2_token_counts", folder)) == want


def test_html(spark, folder):
    found = {r.page_id: r for r in rows(spark, "op3_html_extraction", folder)}
    source = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    from freshness.llm.html_text import leaf_blocks

    assert len(found) == len(source)
    same = 0
    for key, page in source.items():
        want = " ".join(b.text for b in leaf_blocks(page or "") if "article" in b.path and ".ad" not in b.path)
        same += found[key].text == want
        assert found[key].n_chars == len(found[key].text)
    assert found[-1].text == found[-2].text == found[-4].text == ""
    assert same >= 0.96 * len(source)


def test_quality_classifier(spark, folder, texts):
    found = rows(spark, "op5_quality_classifier", folder)
    assert Counter(r.doc_id for r in found) == Counter(d for d, _ in texts)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.quality is not None}
    assert all(r.held_out == in_fold(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    held = [(r.predicted, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) >= 0.8


def test_packing(spark, folder, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    want = Counter((d, tuple(tok.encode(t or "", add_special_tokens=False).ids) + (2,)) for d, t in texts)
    by_doc = defaultdict(list)
    found = rows(spark, "op6_packing", folder)
    for d, ids in want:
        by_doc[d].append(ids)
    for r in found:
        parts = [np.array(ids[r.start : r.start + r.length], "<u4") for ids in by_doc[r.doc_id] if len(ids) == r.doc_tokens]
        assert any(zlib.crc32(p.tobytes()) == r.ids_crc32 for p in parts)
    assert sum(r.length for r in found) == sum(len(ids) * n for (_, ids), n in want.items())
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) * 4096 < 1.1 * sum(r.length for r in found) + 4096


def brute_components(texts, percent=80):
    sets = []
    for _, text in texts:
        w = (text or "").encode().lower().split()
        n = min(5, len(w))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in at[x])
        for x in s:
            at[x].append(i)
        for j, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(texts, sets)))


def test_jaccard_join(spark, folder, texts):
    assert Counter(tuple(r) for r in rows(spark, "op7_jaccard_join", folder)) == brute_components(texts)


def test_chosen_path(spark, folder, texts):
    found = rows(spark, "op11_chosen_path", folder)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(texts, 85)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in found)


def test_quality_rules(spark, folder, texts):
    want = Counter()
    for d, text in texts:
        raw, w = (text or "").encode(), words(text)
        at = defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        again = {i + k for starts in at.values() if len(starts) > 1 for i in starts for k in range(5)}
        seen, dup = set(), 0
        for line in raw.split(b"\n"):
            if line.split():
                dup += line in seen
                seen.add(line)
        failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
        want[d, len(w), sum(len(x.decode()) for x in w), sum(raw.count(c) for c in b"#*$%&|<>"), dup, len(again), failed] += 1
    found = rows(spark, "op8_quality_rules", folder)
    assert Counter(tuple(r)[:7] for r in found) == want
    assert all(not (r.base_failed and r.kept) for r in found) and any(r.kept for r in found)


def test_lm_score(spark, folder, texts):
    order = 5
    train = [not in_fold(d, 7, 2) for d, _ in texts]
    w = [(t or "").encode().lower().split() for _, t in texts]
    count, ends = Counter(), sum(train)
    trie = [defaultdict(Counter) for _ in range(order + 1)]
    lines = [b"\xff" * order + b" ".join(x) + b"\xff" for x in w]
    for x, line, t in zip(w, lines, train):
        if t:
            count.update(x)
            for i in range(order, len(line)):
                for k in range(order + 1):
                    trie[k][line[i - k : i]][line[i]] += 1
    total, scale = sum(count.values()) + ends, math.log10(sum(count.values()) + ends + len(count) + 2)

    def model(line):
        out = 0.0
        for i in range(order, len(line)):
            excluded = set()
            for k in range(order, -1, -1):
                left = {s: n for s, n in trie[k].get(line[i - k : i], {}).items() if s not in excluded}
                if not left:
                    continue
                size = sum(left.values())
                if line[i] in left:
                    out += math.log10((2 * left[line[i]] - 1) / (2 * size))
                    break
                out += math.log10(len(left) / (2 * size))
                excluded |= set(left)
            else:
                out -= math.log10(256 - len(excluded))
        return out

    found = defaultdict(list)
    for r in rows(spark, "op10_lm_score", folder):
        found[r.doc_id].append(r)
    random.seed(1)
    for i, (d, _) in enumerate(texts):
        known = sum(count[x] > 0 for x in w[i]) + 1
        match = [r for r in found[d] if r.n_tokens == len(w[i]) + 1 and r.n_known == known]
        assert match and all(r.held_out == (not train[i]) and r.train_tokens == total for r in match)
        base = sum(math.log10(count[x] + 1) for x in w[i]) + math.log10(ends + 1) - (len(w[i]) + 1) * scale
        assert any(math.isclose(r.base_score, base, rel_tol=1e-9) for r in match)
        if len(lines[i]) < 3000 and (d is None or d < 0 or random.random() < 0.3):
            want = model(lines[i])
            assert any(math.isclose(r.score, want, rel_tol=1e-6) for r in match)
