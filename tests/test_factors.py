import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshness.operators import factors as X, folds
from freshness.operators.folds import fold_scan
from freshness.operators.ordered import width_slice, with_global_rank
from freshness.plans.catalog import QUERIES

D = 3


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    items = {i: rng.normal(size=D) for i in range(12)}
    rows = []
    for t in range(150):
        user = 1 if t % 3 else int(rng.integers(2, 6))
        rows.append((user, int(rng.integers(0, 12)), t, float(rng.uniform(1, 5))))
    return items, pd.DataFrame(rows, columns=["user", "item", "t", "y"])


@pytest.fixture(scope="module")
def rated(spark, data):
    items, rows = data
    vecs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in items.items()], "item LONG, m ARRAY<DOUBLE>")
    return spark.createDataFrame(rows).join(vecs, "item"), vecs


def test_ridge_equals_closed_form(rated, data):
    items, rows = data
    got = {r.user: np.array(r.user_vec) for r in X.ridge_fold_in(rated[0], "user", "m", "y", D - 1, 0.1).collect()}
    for user, g in rows.groupby("user"):
        x = np.stack([items[i][: D - 1] for i in g["item"]])
        y = g["y"].to_numpy() - np.array([items[i][-1] for i in g["item"]])
        xc, yc = x - x.mean(0), y - y.mean()
        w = np.linalg.solve(xc.T @ xc + 0.1 * np.eye(D - 1), xc.T @ yc)
        np.testing.assert_allclose(got[user], np.append(w, y.mean() - x.mean(0) @ w))


def test_normal_equations(rated, data):
    items, rows = data
    got = {r.user: np.array(r.user_vec) for r in X.normal_eq_fold_in(rated[0], "user", "m", "y", D, 10.0).collect()}
    for user, g in rows.groupby("user"):
        m = np.stack([items[i] for i in g["item"]])
        np.testing.assert_allclose(got[user], np.linalg.solve(m.T @ m + 10 * np.eye(D), m.T @ g["y"].to_numpy()))


def test_implicit_fold_in(spark, rated, data):
    items, rows = data
    events = spark.createDataFrame(rows)
    got = {r.user: np.array(r.user_vec) for r in X.implicit_fold_in(events, rated[1], "user", "item", "m", D, 4.0, 0.5).collect()}
    every = np.stack(list(items.values()))
    for user, g in rows.groupby("user"):
        counts = g.groupby("item").size()
        a, b = every.T @ every + 0.5 * np.eye(D), np.zeros(D)
        for i, n in counts.items():
            a += 4.0 * n * np.outer(items[i], items[i])
            b += (1 + 4.0 * n) * items[i]
        np.testing.assert_allclose(got[user], np.linalg.solve(a, b))


def loop(items, rows, start, lr, reg):
    u = {k: v.copy() for k, v in start.items()}
    for r in rows.sort_values("t").itertuples():
        m = items[r.item]
        u[r.user] = u[r.user] + lr * ((r.y - u[r.user] @ m) * m - reg * u[r.user])
    return u


@pytest.mark.parametrize("block,fan", [(1000, 10), (4, 3), (1, 2)])
def test_sgd_fold_equals_the_loop(spark, rated, data, block, fan):
    items, rows = data
    start = {u: np.full(D, 0.1 * u) for u in range(1, 6)}
    users = spark.createDataFrame([(u, [float(x) for x in v]) for u, v in start.items()], "user LONG, user_vec ARRAY<DOUBLE>")
    params = [(0.05, 0.01), (0.1, 0.0)]
    out = X.sgd_fold(rated[0], users, "user", "t", "m", "y", params, width_slice("t", 20), block_rows=block, fan=fan).collect()
    assert len(out) == len(params) * rows["user"].nunique()
    for lr, reg in params:
        want = loop(items, rows, start, lr, reg)
        for r in out:
            if (r.lr, r.reg) == (lr, reg):
                np.testing.assert_allclose(r.user_vec, want[r.user])


def test_learning_curve_and_grid(spark, rated, data):
    items, rows = data
    start = {u: np.full(D, 0.1) for u in range(1, 6)}
    users = spark.createDataFrame([(u, [0.1] * D) for u in start], "user LONG, user_vec ARRAY<DOUBLE>")
    train, test = rated[0].where("t < 100"), rated[0].where("t >= 100")
    held = rows[rows["t"] >= 100]
    error = lambda u: np.mean([(r.y - u[r.user] @ items[r.item]) ** 2 for r in held.itertuples()])
    curve = {r.checkpoint: r for r in X.learning_curve(train, test, users, "user", "t", "m", "y", D, 25, 0.05, 0.01).collect()}
    known = set(rows[rows["t"] < 100]["user"])
    assert known >= set(held["user"])
    for c in range(0, 5):
        after = loop(items, rows[rows["t"] < c * 25], start, 0.05, 0.01)
        assert curve[c].mse == pytest.approx(error(after))
        assert curve[c].fixed_mse == pytest.approx(error(start))
    grid = X.grid_search(train, test, users, "user", "t", "m", "y", D, [0.01, 0.1], [0.0, 0.1], width_slice("t", 30)).collect()
    for r in grid:
        assert r.mse == pytest.approx(error(loop(items, rows[rows["t"] < 100], start, r.lr, r.reg)))
    assert [r.mse for r in grid] == sorted(r.mse for r in grid)


@pytest.mark.parametrize("block,fan", [(1000, 10), (4, 3)])
def test_a_hot_user_and_rows_without_values(spark, block, fan):
    rng = np.random.default_rng(7)
    items = {i: rng.normal(size=D) for i in range(9)}
    rows = [(1 if t % 4 else 2 + t % 3, int(rng.integers(0, 9)), t, float(rng.uniform(1, 5))) for t in range(400)]
    odd = [(1, 0, 17, None), (None, 1, 18, 2.0), (9, 2, 19, 3.0)]  # no rating, no user, a user without start vector
    vecs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in items.items()], "item LONG, m ARRAY<DOUBLE>")
    events = spark.createDataFrame(rows + odd, "user LONG, item LONG, t LONG, y DOUBLE").join(vecs, "item")
    start = {u: np.full(D, 0.2) for u in range(1, 6)}
    users = spark.createDataFrame([(u, [0.2] * D) for u in start], "user LONG, user_vec ARRAY<DOUBLE>")
    frame = pd.DataFrame(rows, columns=["user", "item", "t", "y"])
    out = X.sgd_fold(events, users, "user", "t", "m", "y", [(0.05, 0.01)], F.lit(0), block_rows=block, fan=fan).collect()
    want = loop(items, frame, start, 0.05, 0.01)
    assert {r.user for r in out} == set(frame["user"])
    for r in out:
        np.testing.assert_allclose(r.user_vec, want[r.user])
    known = events.where("user <> 9 AND y IS NOT NULL")
    error = lambda u: np.mean([(r.y - u[r.user] @ items[r.item]) ** 2 for r in frame.itertuples()])
    curve = X.learning_curve(known, known, users, "user", "t", "m", "y", D, 90, 0.05, 0.01, block, fan).orderBy("checkpoint").collect()
    assert [r.checkpoint for r in curve] == list(range(6))
    for r in curve:
        assert r.mse == pytest.approx(error(loop(items, frame[frame["t"] < r.checkpoint * 90], start, 0.05, 0.01)))
    for levels in (0, 2):
        out = fold_scan(known, users, "user", "t", "m", "y", [(0.05, 0.01)], F.lit(0), "user_vec", None, block, fan, levels).collect()
        assert len(out) == len(set(frame["user"]))
        for r in out:
            np.testing.assert_allclose(r._after, want[r.user])
    nothing = events.where("false")
    assert X.sgd_fold(nothing, users, "user", "t", "m", "y", [(0.05, 0.01)], F.lit(0)).count() == 0


def test_alternation_fits_low_rank_ratings(spark):
    rng = np.random.default_rng(3)
    u, m = rng.normal(size=(20, 2)), rng.normal(size=(15, 2))
    rows = [(i, j, float(u[i] @ m[j])) for i in range(20) for j in range(15) if rng.random() < 0.8]
    ratings = spark.createDataFrame(rows, "u LONG, i LONG, y DOUBLE")
    users, items = X.ridge_alternate(ratings, "u", "i", "y", 2, 6)
    joined = ratings.join(users, "u").join(items, "i").collect()
    guess = [np.dot(r.user_vec[:2], r.item_vec[:2]) + r.user_vec[2] + r.item_vec[2] for r in joined]
    assert np.mean((np.array(guess) - [r.y for r in joined]) ** 2) < 0.05 * np.var([r.y for r in joined])


@pytest.mark.parametrize("factors,rounds,block", [(2, 3, 65_536), (5, 2, 20)])
def test_alternation_equals_the_loop(spark, factors, rounds, block):
    """Whole and cut keys, ratings that come twice, null users, items and ratings."""
    rng = np.random.default_rng(3)
    rows = [(1 if k % 3 else int(rng.integers(0, 20)), int(rng.integers(0, 15)), float(rng.uniform(1, 5))) for k in range(200)]
    rows += rows[:5] + [(None, 3, 2.0), (None, 4, 3.0), (2, None, 2.0), (30, None, 2.0), (3, 3, None)]
    ratings = spark.createDataFrame(rows, "u LONG, i LONG, y DOUBLE")

    def fits(vectors, key, other):
        out = {}
        for k in {r[key] for r in rows}:
            mine = [r for r in rows if r[key] == k and r[other] is not None and r[other] in vectors]
            if mine:
                m = np.stack([vectors[r[other]] for r in mine])
                x, y = m[:, :factors], np.array([0.0 if r[2] is None else r[2] - b for r, b in zip(mine, m[:, factors])])
                xc, yc = x - x.mean(0), y - y.mean()
                w = np.linalg.solve(xc.T @ xc + 0.001 * np.eye(factors), xc.T @ yc)
                out[k] = np.append(w, y.mean() - x.mean(0) @ w)
        return out

    items = {r.i: np.array(r.v) for r in X.start_vectors(ratings, "i", factors + 1, 1, "v").collect()}
    for _ in range(rounds):
        users = fits(items, 0, 1)
        items = fits(users, 1, 0)
    got = X.ridge_alternate(ratings, "u", "i", "y", factors, rounds, block_rows=block)
    for side, key, want in zip(got, ("u", "i"), (users, items)):
        found = {r[key]: r[1] for r in side.collect()}
        assert found.keys() == want.keys()
        for k in want:
            np.testing.assert_allclose(found[k], want[k], rtol=1e-6, atol=1e-8)


def test_alternation_is_registered_with_all_rounds_and_factors(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, 1, 7, 3, 9.0, 10.0)], "l_orderkey LONG, l_linenumber LONG, l_partkey LONG, l_suppkey LONG, l_extendedprice DOUBLE, l_quantity DOUBLE").withColumn(
        "l_shipdate", F.lit("1999-01-02").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 5)], "o_orderkey LONG, o_custkey LONG").withColumn("o_orderdate", F.lit("1999-01-01").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/orders.parquet")
    refits, refit = [], X._refit

    def spy(*args):
        refits.append(args[4])
        return refit(*args)

    monkeypatch.setattr(X, "_refit", spy)
    rows = QUERIES["ridge_alternate"](spark, str(tmp_path)).collect()
    assert sorted((r.user_id, r.i) for r in rows) == [(5, i) for i in range(51)]
    assert refits == [50] * 100


def test_sgd_both_lowers_the_error(spark, rated):
    full, vecs = rated
    items = vecs.withColumnRenamed("m", "item_vec")
    users = full.select("user").distinct().withColumn("user_vec", F.array(*[F.lit(0.1)] * D))
    base = full.select("user", "item", "y")

    def error(us, its):
        rows = base.join(us, "user").join(its, "item").collect()
        return np.mean([(r.y - np.dot(r.user_vec, r.item_vec)) ** 2 for r in rows])

    before = error(users, items)
    assert error(*X.sgd_both(base, users, items, "user", "item", "y", D, 0.2, 0.0, 4)) < before


def test_recommend_over_blocks_equals_brute_force(spark):
    """Users and items in several blocks; equal scores go to the lower item, unknown users are left out."""
    rng = np.random.default_rng(4)
    u = rng.integers(-2, 3, size=(23, 3)).astype(np.float32)
    v = np.concatenate([np.repeat(rng.integers(-2, 3, size=(20, 3)), 3, axis=0), rng.integers(-2, 3, size=(5, 3))]).astype(np.float32)
    table = lambda x: spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "id INT, features ARRAY<FLOAT>")

    class Model:
        rank, userFactors, itemFactors = 3, table(u), table(v)
        getUserCol, getItemCol = staticmethod(lambda: "u"), staticmethod(lambda: "i")

    got = X.recommend(Model, spark.range(1, 40).select(F.col("id").alias("u")), 4, 5, 2, 2).collect()
    scores = u @ v.T
    want = {(a, k + 1, i, float(scores[a, i])) for a in range(1, 23) for k, i in enumerate(sorted(range(65), key=lambda i: (-scores[a, i], i))[:4])}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    few = X.recommend(Model, spark.range(3).select(F.col("id").alias("u")), 70).collect()
    assert len(few) == 3 * 65


def test_gram_sums_shuffle_ratings_and_no_sums(rated):
    plan = X.gram_sums(rated[0], "user", "m", F.col("y"), D)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" not in plan[plan.index("Exchange") :]


def test_moments_read_the_test_rows_once(rated):
    plan = X.test_moments(rated[0], "user", "m", "y", D)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ExistingRDD") == 1  # the item vectors


@pytest.mark.parametrize("block", [1000, 60])
def test_only_events_of_long_users_are_numbered(spark, rated, data, monkeypatch, block):
    items, rows = data
    users = spark.createDataFrame([(u, [0.1] * D) for u in range(1, 6)], "user LONG, user_vec ARRAY<DOUBLE>")
    numbered = []

    def spy(df, *args, **kwargs):
        numbered.append({r.user: r["count"] for r in df.groupBy("user").count().collect()})
        return with_running(df, *args, **kwargs)

    with_running = folds.with_running
    monkeypatch.setattr(folds, "with_running", spy)
    out = X.sgd_fold(rated[0], users, "user", "t", "m", "y", [(0.05, 0.01), (0.1, 0.0)], width_slice("t", 20), block_rows=block).collect()
    sizes = rows.groupby("user").size()
    assert numbered == [{u: n for u, n in sizes.items() if n > block}]
    for lr, reg in [(0.05, 0.01), (0.1, 0.0)]:
        want = loop(items, rows, {u: np.full(D, 0.1) for u in range(1, 6)}, lr, reg)
        for r in out:
            if r.lr == lr:
                np.testing.assert_allclose(r.user_vec, want[r.user])


def test_a_long_user_without_a_start_is_left_out(spark, rated):
    users = spark.createDataFrame([(u, [0.1] * D) for u in range(2, 6)], "user LONG, user_vec ARRAY<DOUBLE>")
    out = X.sgd_fold(rated[0], users, "user", "t", "m", "y", [(0.05, 0.01)], width_slice("t", 20), block_rows=10, fan=2)
    assert {r.user for r in out.collect()} == {2, 3, 4, 5}


def test_global_rank_keeps_what_is_asked_for(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101, "x" * (i % 3)) for i in range(300)] + [(300, None, "y")], "i LONG, v LONG, s STRING")
    got = with_global_rank(df.repartition(5), ["v", "i"], "at", ["i"])
    assert got.columns == ["i", "at"]
    order = sorted(range(301), key=lambda i: (i < 300, (i * 37) % 101, i))
    assert {r.i: r["at"] for r in got.collect()} == {i: k + 1 for k, i in enumerate(order)}
    assert with_global_rank(df.where("false"), ["v", "i"], "at").collect() == []


def test_als_has_the_same_factors_with_fewer_item_blocks(spark):
    rng = np.random.default_rng(3)
    seen = {(int(rng.integers(0, 40)), int(rng.integers(0, 30))) for _ in range(500)}
    ratings = spark.createDataFrame([(u, i, float(rng.uniform(1, 5))) for u, i in sorted(seen)], "u LONG, i LONG, y DOUBLE")
    sides = []
    for blocks in (10, 5):
        model = X.als_train(ratings, "u", "i", "y", rank=3, iters=4, item_blocks=blocks)
        sides.append([{r.id: r.features for r in f.collect()} for f in (model.userFactors, model.itemFactors)])
    for one, other in zip(*sides):
        assert one.keys() == other.keys()
        for k in one:
            np.testing.assert_allclose(one[k], other[k], rtol=1e-3, atol=1e-4)


def test_als_has_more_blocks_for_more_ratings(spark, monkeypatch):
    rng = np.random.default_rng(5)
    seen = sorted({(int(rng.integers(0, 40)), int(rng.integers(0, 30))) for _ in range(700)})
    u, m = rng.uniform(1, 2, size=(40, 2)), rng.uniform(0.5, 1, size=(30, 2))
    ratings = spark.createDataFrame([(a, b, float(u[a] @ m[b])) for a, b in seen], "u LONG, i LONG, y DOUBLE")
    blocks, als = [], X.ALS

    def spy(**options):
        blocks.append((options["numUserBlocks"], options["numItemBlocks"]))
        return als(**options)

    monkeypatch.setattr(X, "ALS", spy)
    for size in (4_000_000, 20):
        model = X.als_train(ratings, "u", "i", "y", rank=2, iters=8, reg=0.01, block_ratings=size)
        assert model.userFactors.count() == len({a for a, _ in seen}) and model.itemFactors.count() == len({b for _, b in seen})
        assert X.rating_rmse(model, ratings, "y").first().rmse < 0.2
    many = -(-len(seen) // 20)
    assert many > 10 and blocks == [(10, 5), (many, many)]
