"""Near duplicates, hard negatives and spelling variants against plain loops, with limits so small that every path is taken."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("freshness.llm.queries")
from freshness.llm import chosen_path, hard_negatives, jaccard_join, set_pairs, spelling
from tests.llm.test_queries import brute_components


def family(rng, base, count, changes):
    """Near copies of one text; the number of changed words varies, so pairs lie on both sides of the threshold."""
    words = [f"w{base}_{i}" for i in range(60)]
    for _ in range(count):
        copy = list(words)
        for _ in range(rng.randint(0, changes)):
            copy[rng.randrange(len(copy))] = f"new{rng.random()}"
        yield " ".join(copy)


def test_chosen_path_branches(spark, monkeypatch):
    """Nodes that are no leaves branch until they are, and cells are cut into chunks and parts."""
    rng = random.Random(3)
    monkeypatch.setattr(chosen_path, "OUTSIDE", 6)
    monkeypatch.setattr(chosen_path, "CHUNK", 5)
    monkeypatch.setattr(chosen_path, "HELD", 4096)
    texts = [t for base in range(3) for t in family(rng, base, 40, 4)]
    texts = list(enumerate([*texts, *texts[:5], "", None, "one two", "ONE  two"], 1))
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("key", "node", "component", "n", "a")})
    found = chosen_path.link_near_copies(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(texts, 85)


def test_rows_grow_with_a_large_group(spark, monkeypatch):
    """2,000 near copies: what enters the cells of the Jaccard join is a few rows for each text, not a row for each pair."""
    rng = random.Random(4)
    texts = list(enumerate(family(rng, 0, 2000, 2), 1))
    seen = []
    real = jaccard_join._in_cells
    monkeypatch.setattr(jaccard_join, "_in_cells", lambda cells, more: seen.append(cells.count()) or real(cells, more))
    found = jaccard_join.link_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert len({r.component_id for r in found}) < len(found) and all(n <= 20 * len(texts) for n in seen), seen


def test_minwise_tokens_estimate_similarity():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.unique(tokens[:2000]), np.unique(tokens[200:2200])
    x, y = chosen_path.minwise([a, b])
    assert abs((x == y).mean() - 1800 / 2200) < 0.2
    assert set_pairs.shared(a, b) == len(np.intersect1d(a, b))


def test_similar_pairs_with_split_hubs(spark, monkeypatch):
    monkeypatch.setattr(set_pairs, "PART", 100)
    texts = list(enumerate(family(random.Random(5), 1, 30, 5), 1))
    source = spark.createDataFrame(texts, "doc_id long, text string")
    sets = {t: s for (_, t), s in zip(texts, set_pairs.shingle_sets([t.encode() for _, t in texts], 5))}
    keys = {set_pairs.set_key(s): s for s in sets.values()}
    classes = spark.createDataFrame([(k, set_pairs.key_head(k), len(s)) for k, s in keys.items()], "key binary, head long, n long")
    hub = min(keys)
    pairs = spark.createDataFrame([(k, hub) for k in keys if k != hub], "a binary, b binary")
    got = {bytes(r.a) for r in set_pairs.similar_pairs(source, classes, pairs, 80, 5).collect()}
    like = lambda a, b: 100 * set_pairs.shared(a, b) >= 80 * (len(a) + len(b) - set_pairs.shared(a, b))
    assert got == {k for k, s in keys.items() if k != hub and like(keys[hub], s)}


@pytest.mark.parametrize("size,width", [(100, 64), (3, 2000), (2**20, 8)])
def test_residue_scores_are_exact(size, width):
    rng = np.random.default_rng(2)
    a, b = rng.integers(-size, size + 1, (7, width)), rng.integers(-size, size + 1, (9, width))
    bound = int(np.ceil(np.sqrt((a * a).sum(1).max()) * np.sqrt((b * b).sum(1).max()))) + 1
    primes = hard_negatives.primes_for(bound)
    got = hard_negatives.signed_scores(hard_negatives.residues(a, primes), hard_negatives.residues(b, primes), primes)
    assert (got == a @ b.T).all()
    with pytest.raises(ValueError):
        hard_negatives.primes_for(1 << 60)


def test_hard_negatives_in_small_groups(spark, monkeypatch):
    """Many groups, slices and tiles; ties, short and empty vectors, columns of the operator's own names."""
    monkeypatch.setattr(hard_negatives, "GROUP", 3)
    monkeypatch.setattr(hard_negatives, "SLICE", 16)
    monkeypatch.setattr(hard_negatives, "TILE", 40)
    rng = random.Random(6)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(rng.choice([4, 4, 3, 0]))], rng.randrange(3)) for i in range(90)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("q", "tie", "cell", "kind", "score")})
    got = sorted(map(tuple, hard_negatives.mine_hard_negatives(vectors, F.col("vec_id") % 10 == 0, scale=1, positives=3, negatives=2).collect()))
    score = lambda x, y: int(sum(p * q for p, q in zip(x, y)))
    want = []
    for i, x, label in rows[::10]:
        others = sorted((-score(x, y), j, lab) for j, y, lab in rows if j != i)
        for p, j, _ in [o for o in others if o[2] == label][:3]:
            hard = [o for o in others if o[2] != label and 80 * -p <= 100 * -o[0] <= 100 * -p][:2]
            want += [(i, j, rank, n, -p, -s) for rank, (s, n, _) in enumerate(hard, 1)]
    assert got == sorted(want) and want
    big = spark.createDataFrame([(0, [1e30], 1), (1, [1e30], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError):
        hard_negatives.mine_hard_negatives(big, F.col("vec_id") == 0)


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


@pytest.mark.parametrize("piece,groups", [(2048, 1), (3, 4), (5, 12)])
def test_near_words(spark, monkeypatch, piece, groups):
    monkeypatch.setattr(spelling, "PIECE", piece)
    monkeypatch.setattr(spelling, "LEVELS", (groups,))
    rng = random.Random(7)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 7))) for _ in range(250)}
    long = "x" * 3000  # letter counts beyond what float32 squares hold exactly
    words |= {long, long + "x", long[:-1] + "y", long[:100] + "z" + long[100:]}
    found = spelling.near_words(spelling.stage(spark.createDataFrame([(w, 3) for w in words], "word string, n long"))).collect()
    assert len({frozenset((r.a, r.b)) for r in found}) == len(found)
    assert {frozenset((r.a, r.b)) for r in found} == {frozenset((a, b)) for a in words for b in words if a < b and distance_one(a, b)}


def test_runs_of_long_texts(monkeypatch):
    text = "ab, cde éà×y  " * 50 + "q" * 90 + " end"
    whole = Counter(spelling.RUN.findall(text))
    monkeypatch.setattr(spelling, "SLAB", 7)
    assert spelling.runs_of(text) == whole


def test_chains_of_forms(spark):
    words = [("aaaaa", 1), ("aaaab", 2), ("aaabb", 4), ("aabbb", 8), ("abbbb", 16), ("zzzzz", 5), ("zzzzy", 9)]
    got = {r.word: (r.form, r.form_n, r.n_near, r.root) for r in spelling.spelling_forms(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got["aaaaa"] == ("aaaab", 2, 1, "abbbb") and got["aabbb"] == ("abbbb", 16, 2, "abbbb") and got["abbbb"] == (None, None, 1, "abbbb")
    assert got["zzzzz"] == (None, None, 1, "zzzzz")
