"""Factor vectors: training, refits of single users, ordered gradient folds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from freshness.functions.scalars import dot_fixed
from freshness.operators.folds import fold_scan
from freshness.operators.joins import vector_moments
from freshness.operators.ordered import names, with_global_rank, with_running
from freshness.operators.windows import uniform_draw
from freshness.session import stage, unstage

VECTOR = T.ArrayType(T.DoubleType())
USER_BLOCKS = 10  # of an ALS fit: the number that Spark takes by itself


def als_train(
    ratings, user, item, rating, rank=8, iters=10, reg=0.1, seed=1, implicit=False, alpha=1.0, item_blocks=5, block_ratings=4_000_000
) -> ALSModel:
    """Factor model of all ratings; cold rows are dropped when it predicts.

    The ratings are stored first, as the fit reads them more than once. Each round sends a user's factors once to every block of items that
    has one of theirs, so half of the default blocks save half of that. A fit starts from the user factors, drawn by user block: their number stays.
    A task gathers a whole block on the heap, so with more than `block_ratings` to a block both sides have more blocks (and other draws), and what
    the rounds have shuffled is freed more often.
    """
    stored = stage(ratings.select(F.col(user).cast("int"), F.col(item).cast("int"), F.col(rating).cast("float")))
    least = -(-stored.count() // block_ratings)
    als = ALS(
        userCol=user, itemCol=item, ratingCol=rating, rank=rank, maxIter=iters, regParam=reg, seed=seed,
        implicitPrefs=implicit, alpha=alpha, coldStartStrategy="drop", checkpointInterval=5 if least <= USER_BLOCKS else 2,
        numUserBlocks=max(USER_BLOCKS, least), numItemBlocks=max(item_blocks, least),
    )
    return als.fit(stored)


def als_train_implicit(events, user, item, rank=8, iters=10, reg=0.1, alpha=40.0, seed=1) -> ALSModel:
    """Factors from interaction counts."""
    counts = events.groupBy(user, item).agg(F.count(F.lit(1)).alias("n"))
    return als_train(counts, user, item, "n", rank, iters, reg, seed, implicit=True, alpha=alpha)


def oracle_factors(train, later, user, item, rating, **options) -> ALSModel:
    """The best case: a fit on the training rows and everything that came later."""
    return als_train(train.unionByName(later), user, item, rating, **{"iters": 20, **options})


def _packed(factors: DataFrame, rows: int, name: str, together: int = 1) -> DataFrame:
    """Factors (id, features) as blocks of about `rows` rows, `together` to a partition: ids and vectors as bytes, ids ascending."""
    blocks = max(1, -(-factors.count() // rows))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        vectors = np.stack(frame["features"].to_numpy()).astype(np.float32)
        return pd.DataFrame({f"{name}_id": [frame["id"].to_numpy(np.int32).tobytes()], f"{name}_vec": [vectors.tobytes()]})

    numbered = factors.select("id", "features", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("_block"))
    return numbered.groupBy("_block").applyInPandas(pack, f"{name}_id binary, {name}_vec binary").repartition(-(-blocks // together))


def _keep_best(best: tuple, u: np.ndarray, ids: np.ndarray, v: np.ndarray) -> tuple:
    """The best (scores, ids) of each row of `u` after more items; equal scores go to the lower id.

    A matrix product finds the scores that can enter, up to its rounding; these few are added up as the model does, in 32 bits.
    """
    kept, found = best
    n = kept.shape[1]
    about = 4 * u.shape[1] * np.finfo(np.float32).eps * np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1).max()
    scores = u @ v.T
    floor = kept[:, -1] - about
    if np.isneginf(floor).any() and len(ids) > n:
        floor = np.maximum(floor, np.partition(scores, -n, axis=1)[:, -n] - 2 * about)
    row, col = np.divmod(np.flatnonzero(scores >= floor[:, None].astype(np.float32)), len(ids))
    if not len(row):
        return best
    exact = np.zeros(len(row), np.float32)
    for i in range(u.shape[1]):
        exact += u[row, i] * v[col, i]
    hit, place = np.unique(row, return_inverse=True)
    rows = np.concatenate([np.repeat(np.arange(len(hit)), n), place])
    values, which = np.concatenate([kept[hit].ravel(), exact]), np.concatenate([found[hit].ravel(), ids[col]])
    order = np.lexsort((which, -values, rows))
    first = np.searchsorted(rows[order], np.arange(len(hit)))
    take = order[first[:, None] + np.arange(n)]
    kept, found = kept.copy(), found.copy()
    kept[hit], found[hit] = values[take], which[take]
    return kept, found


def recommend(model: ALSModel, users: DataFrame, n: int, user_rows: int = 2_048, item_rows: int = 65_536, slice_rows: int = 2_048) -> DataFrame:
    """The n best items of the given users, one row each; equal scores go to the lower item.

    All pairs are scored, as small matrix products: a task holds the vectors of one block of users and the n best items so far of
    each, and reads up to 16 blocks of items. Only scores that can pass a user's n-th best are looked at again.
    """
    user, item = model.getUserCol(), model.getItemCol()
    rank = model.rank
    wanted = model.userFactors.join(users.select(F.col(user).alias("id")), "id", "left_semi")
    blocks = _packed(wanted, user_rows, "user").hint("shuffle_replicate_nl").crossJoin(_packed(model.itemFactors, item_rows, "item", 16))

    def rows_of(ids: np.ndarray, best: tuple) -> pd.DataFrame:
        row, col = np.nonzero(best[1] >= 0)
        return pd.DataFrame({user: ids[row], item: best[1][row, col].astype(np.int32), "score": best[0][row, col]})

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = None
        for frame in frames:
            for u_id, u_vec, i_id, i_vec in frame[["user_id", "user_vec", "item_id", "item_vec"]].itertuples(index=False):
                if u_id != at:
                    if at is not None:
                        yield rows_of(ids, best)
                    at, ids, u = u_id, np.frombuffer(u_id, np.int32), np.frombuffer(u_vec, np.float32).reshape(-1, rank)
                    best = np.full((len(ids), n), -np.inf, np.float32), np.full((len(ids), n), -1, np.int64)
                items, v = np.frombuffer(i_id, np.int32).astype(np.int64), np.frombuffer(i_vec, np.float32).reshape(-1, rank)
                for start in range(0, len(items), slice_rows):
                    best = _keep_best(best, u, items[start : start + slice_rows], v[start : start + slice_rows])
        if at is not None:
            yield rows_of(ids, best)

    place = F.row_number().over(W.partitionBy(user).orderBy(F.desc("score"), item))
    first = blocks.mapInPandas(each, f"{user} int, {item} int, score float").withColumn("rank", place).where(F.col("rank") <= n)
    return first.select(user, "rank", item, "score")


def rating_rmse(model: ALSModel, rows: DataFrame, rating: str) -> DataFrame:
    """One row: root mean squared error on the rows the model can predict."""
    cols = [F.col(c).cast("int") for c in (model.getUserCol(), model.getItemCol())]
    predicted = model.transform(rows.select(*cols, rating))
    miss = F.col("prediction") - F.col(rating)
    return predicted.agg(F.sqrt(F.avg(miss * miss)).alias("rmse"), F.count(miss).alias("n"))


def gram_sums(rated: DataFrame, user, vector: str, target: Column, size: int, weight: Column | None = None, more: Sequence[Column] = ()) -> DataFrame:
    """Sums behind every linear refit of a user: n, X'X (flat), X'y, sums of X and y, and the aggregates of `more`.

    A rating is a few times shorter than its sums, and a user's ratings lie on almost as many tasks as there are. So ratings and not
    partial sums are shuffled; a task reads them as a stream and holds one row of sums for each of its users, whatever their length.
    """
    v, w = F.col(vector), F.lit(1.0) if weight is None else weight
    x = [F.get(v, F.lit(i)) for i in range(size)]
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(target).alias("sum_y")]
    aggs += [F.sum(x[i]).alias(f"_s{i}") for i in range(size)]
    aggs += [F.sum(x[i] * target).alias(f"_r{i}") for i in range(size)]
    aggs += [F.sum(w * x[i] * x[j]).alias(f"_g{i}_{j}") for i in range(size) for j in range(i, size)]
    sums = rated.repartition(*names(user)).groupBy(*names(user)).agg(*aggs, *more)
    extra = sums.columns[len(names(user)) + len(aggs) :]
    gram = [f"_g{min(i, j)}_{max(i, j)}" for i in range(size) for j in range(size)]
    return sums.select(
        *names(user), "n", "sum_y", F.array(*[f"_s{i}" for i in range(size)]).alias("sum_x"),
        F.array(*[f"_r{i}" for i in range(size)]).alias("rhs"), F.array(*gram).alias("gram"), *extra,
    )


def _stacked(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float)


@F.pandas_udf(VECTOR)
def _solve(gram: pd.Series, rhs: pd.Series, reg: pd.Series) -> pd.Series:
    b = _stacked(rhs)
    d = b.shape[1] if b.ndim == 2 else 0
    if d == 0:
        return pd.Series([[]] * len(rhs))
    a = _stacked(gram).reshape(-1, d, d) + reg.to_numpy(float)[:, None, None] * np.eye(d)
    return pd.Series(list(np.linalg.solve(a, b[:, :, None])[:, :, 0]))


def _ridge(n: np.ndarray, sum_y: np.ndarray, sum_x: np.ndarray, rhs: np.ndarray, gram: np.ndarray, alpha: np.ndarray | float) -> np.ndarray:
    """Ridge with intercept from the sums of each row; the intercept comes last."""
    count, y, d = n[:, None], sum_y[:, None], sum_x.shape[1]
    mean_x, mean_y = sum_x / count, y / count
    centred = gram.reshape(-1, d, d) - count[:, :, None] * mean_x[:, :, None] * mean_x[:, None, :]
    a = centred + np.reshape(alpha, (-1, 1, 1)) * np.eye(d)
    w = np.linalg.solve(a, (rhs - sum_x * mean_y)[:, :, None])[:, :, 0]
    bias = mean_y - np.sum(mean_x * w, axis=1, keepdims=True)
    return np.concatenate([w, bias], axis=1)


@F.pandas_udf(VECTOR)
def ridge_fit(n: pd.Series, sum_y: pd.Series, sum_x: pd.Series, rhs: pd.Series, gram: pd.Series, alpha: pd.Series) -> pd.Series:
    if len(n) == 0:
        return pd.Series([], dtype=object)
    return pd.Series(list(_ridge(n.to_numpy(float), sum_y.to_numpy(float), _stacked(sum_x), _stacked(rhs), _stacked(gram), alpha.to_numpy(float))))


def ridge_fold_in(rated, user, vector: str, rating: str, factors: int, alpha: float = 0.001) -> DataFrame:
    """Refit users: ridge with intercept on the first `factors` of the item vector.

    The last slot of the item vector is its bias, taken off the rating first; the
    result has the intercept in its last slot.
    """
    target = F.col(rating) - F.element_at(vector, -1)
    sums = gram_sums(rated, user, vector, target, factors)
    fit = ridge_fit("n", "sum_y", "sum_x", "rhs", "gram", F.lit(alpha))
    return sums.select(*names(user), "n", fit.alias("user_vec"))


def normal_eq_fold_in(rated, user, vector: str, rating: str, size: int, reg: float) -> DataFrame:
    """Solve (sum m m' + reg I) u = sum r m over the observed ratings of each user."""
    sums = gram_sums(rated, user, vector, F.col(rating), size)
    return sums.select(*names(user), "n", _solve("gram", "rhs", F.lit(reg)).alias("user_vec"))


def implicit_fold_in(events, items, user, item, vector: str, size: int, alpha: float, reg: float) -> DataFrame:
    """Refit users on interaction counts: confidence 1 + alpha x count, preference 1.

    Solves (Y'Y + sum (c - 1) m m' + reg I) u = sum c m; Y'Y comes once from all items.
    """
    counts = events.groupBy(*names(user), item).agg(F.count(F.lit(1)).alias("_n"))
    rated = counts.join(items, item)
    extra = F.lit(alpha) * F.col("_n")
    sums = gram_sums(rated, user, vector, extra + 1, size, weight=extra)
    everything = vector_moments(items, vector, size).select(F.flatten("gram")).scalar()
    gram = F.zip_with("gram", "_all", lambda a, b: a + b)
    return sums.withColumn("_all", everything).select(*names(user), "n", _solve(gram, "rhs", F.lit(reg)).alias("user_vec"))


def start_vectors(df: DataFrame, key: str, size: int, seed: int, name: str, scale: float = 0.1) -> DataFrame:
    """Repeatable random start vectors for the keys of `df`."""
    draws = [(uniform_draw([F.col(key), F.lit(i)], seed) - 0.5) * scale for i in range(size)]
    return df.select(key).distinct().withColumn(name, F.array(*draws))


def _rating_blocks(ratings: DataFrame, key: str, other: str, block_rows: int) -> tuple[DataFrame, DataFrame, bool]:
    """Stored (_block, key, other, _y, _cut), stored (_block, other) of what a block needs, and whether a key is cut.

    A block has about `block_rows` ratings. A key with more of them is cut into parts that lie in several blocks.
    """
    blocks = max(1, -(-ratings.count() // block_rows))
    long = ratings.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows)
    parts = F.coalesce(F.ceil(F.col("_n") / block_rows), F.lit(1))
    placed = ratings.join(long, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("_cut", parts > 1)
    block = F.pmod(F.xxhash64(key, F.pmod(F.col("_at"), parts)), F.lit(blocks)).alias("_block")
    cells = stage(placed.select(block, key, other, "_y", "_cut"))
    needed = stage(cells.select("_block", other).distinct())
    return cells, needed, not cells.where("_cut").isEmpty()


def _refit(blocks: tuple[DataFrame, DataFrame, bool], vectors: DataFrame, key: str, other: str, factors: int, alpha: float, name: str) -> DataFrame:
    """(key, vector) of `ridge_fold_in` for every key, from blocks of ratings and the vectors (other, _vec) of the other side; stored.

    A vector is sent once to each block that needs it, and a task holds one block, with the sums of a few keys at a time.
    Keys that are cut come back as sums, which are added up.
    """
    cells, needed, any_cut = blocks
    shape = T.StructType([cells.schema[key], T.StructField(name, VECTOR), T.StructField("_sums", VECTOR)])
    d = factors
    ends = np.cumsum([1, 1, 1, d, d, d * d])[:-1]

    def fit(sums: np.ndarray) -> np.ndarray:
        n, n_y, sum_y, sum_x, rhs, gram = np.split(sums, ends, axis=1)
        nothing = np.where(n_y > 0, 0.0, np.nan)  # a key without any rating that is not null
        return _ridge(n[:, 0], (sum_y + nothing)[:, 0], sum_x, rhs + nothing, gram, alpha)

    def each(rated: pa.Table, vecs: pa.Table) -> pa.Table:
        at = pc.index_in(rated[other], value_set=vecs[other].combine_chunks())  # ratings without a vector fall out
        rated, at = rated.filter(at.is_valid()), at.drop_null().to_numpy()
        codes = rated[key].combine_chunks().dictionary_encode(null_encoding="encode")
        keys, code = codes.dictionary, codes.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        first = np.searchsorted(code[order], np.arange(len(keys) + 1))
        at, y, there = at[order], rated["_y"].fill_null(0.0).to_numpy()[order], rated["_y"].is_valid().to_numpy()[order]
        cut = rated["_cut"].to_numpy()[order][first[:-1]]
        vectors = vecs["_vec"].combine_chunks().flatten().to_numpy().reshape(-1, d + 1)
        found, kept = [], []
        for start in range(0, len(keys), 256):
            edge = first[start : start + 257]
            lot = slice(edge[0], edge[-1])
            mine, edge = vectors[at[lot]], edge - edge[0]
            x, target = mine[:, :d], np.where(there[lot], y[lot] - mine[:, d], 0.0)
            sums = np.add.reduceat(np.column_stack([np.ones(len(x)), there[lot], target, x, x * target[:, None]]), edge[:-1])
            grams = [(x[a:b].T @ x[a:b]).ravel() for a, b in zip(edge, edge[1:])]
            sums = np.concatenate([sums, grams], axis=1)
            part = cut[start : start + 256]
            found.append(fit(sums[~part]))
            kept.append(sums[part])
        rows = lambda lists, width: _lists(np.concatenate([np.empty((0, width)), *lists]))
        whole, parts = rows(found, d + 1), rows(kept, ends[-1] + d * d)
        none = lambda n: pa.nulls(n, pa.list_(pa.float64()))
        keys = pa.concat_arrays([keys.filter(pa.array(~cut)), keys.filter(pa.array(cut))])
        return pa.table({key: keys, name: pa.concat_arrays([whole, none(len(parts))]), "_sums": pa.concat_arrays([none(len(whole)), parts])})

    sent = needed.join(vectors, other)
    out = stage(cells.groupBy("_block").cogroup(sent.groupBy("_block")).applyInArrow(each, shape))
    if not any_cut:
        return out.select(key, name)

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        vector = fit(np.sum(frame["_sums"].tolist(), axis=0)[None, :])
        return pd.DataFrame({key: frame[key].iloc[:1], name: list(vector)})

    summed = out.where("_sums IS NOT NULL").groupBy(key).applyInPandas(added, out.select(key, name).schema)
    both = stage(out.where("_sums IS NULL").select(key, name).unionByName(summed))
    unstage(out)
    return both


def _lists(rows: np.ndarray) -> pa.Array:
    """A list of each row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ravel(rows)))


def ridge_alternate(ratings, user, item, rating, factors: int, iters: int, alpha: float = 0.001, seed: int = 1, block_rows: int = 65_536):
    """Alternate ridge refits of users and items; returns (users, items).

    The ratings are dealt once to blocks by user and once to blocks by item. Each half round sends the vectors of one side to the blocks that
    need them and refits the other; its result is written out, so the lineage stays short and a lost executor costs one round. Vectors that
    have been replaced are removed.
    """
    rated = stage(ratings.select(user, item, F.col(rating).cast("double").alias("_y"), F.monotonically_increasing_id().alias("_at")))
    of_users, of_items = _rating_blocks(rated, user, item, block_rows), _rating_blocks(rated, item, user, block_rows)
    items = stage(start_vectors(rated, item, factors + 1, seed, "item_vec"))
    users = None
    for _ in range(iters):
        before = [users, items]
        users = _refit(of_users, items.withColumnRenamed("item_vec", "_vec"), user, item, factors, alpha, "user_vec")
        items = _refit(of_items, users.withColumnRenamed("user_vec", "_vec"), item, user, factors, alpha, "item_vec")
        for old in before:
            if old is not None:
                unstage(old)
    return users, items


def sgd_fold(
    rated, users, user: str, order, vector: str, rating: str, params: list[tuple[float, float]], slice_by,
    user_vec: str = "user_vec", block_rows: int = 1_024, fan: int = 1_024,
) -> DataFrame:
    """Ordered gradient steps on each user vector, item vectors fixed.

    Step: u + lr (err m - reg u), for each (lr, reg) of `params`, by a prefix scan
    over blocks of `block_rows` events (see `folds`). Gives (user, lr, reg,
    user_vec); users without events are left out.
    """
    grid = F.array(*[F.struct(F.lit(float(lr)).alias("lr"), F.lit(float(reg)).alias("reg")) for lr, reg in params])
    out = fold_scan(rated, users, user, order, vector, rating, params, slice_by, user_vec, None, block_rows, fan)
    return out.withColumn("_g", F.get(grid, F.col("_p"))).select(user, "_g.lr", "_g.reg", F.col("_after").alias(user_vec))


def sgd_both(rated, users, items, user, item, rating, size: int, lr: float, reg: float, rounds: int):
    """Mini-batch rounds that move user and item vectors by their mean gradients; returns (users, items)."""

    def moved(rows, table, key, own, other):
        grads = [
            F.avg(F.col("_miss") * F.get(other, F.lit(i)) - F.lit(reg) * F.get(own, F.lit(i))).alias(f"_g{i}") for i in range(size)
        ]
        steps = rows.groupBy(key).agg(*grads).select(key, F.array(*[f"_g{i}" for i in range(size)]).alias("_step"))
        new = F.when(F.col("_step").isNull(), F.col(own)).otherwise(F.zip_with(own, "_step", lambda a, g: a + F.lit(lr) * g))
        return table.join(steps, key, "left").select(key, new.alias(own))

    rated = stage(rated.select(user, item, rating))  # read twice a round; its joins are not repeated
    miss = F.col(rating) - dot_fixed("user_vec", "item_vec", size)
    for _ in range(rounds):
        # the side that moves is joined last, so its gradients are added up where the rows are and no partial sums are shuffled
        by_user = rated.join(items, item).join(users, user).withColumn("_miss", miss)
        by_item = rated.join(users, user).join(items, item).withColumn("_miss", miss)
        users, items = (
            stage(moved(by_user, users, user, "user_vec", "item_vec")),
            stage(moved(by_item, items, item, "item_vec", "user_vec")),
        )
    return users, items


def test_moments(test, user, vector: str, rating: str, size: int) -> DataFrame:
    """Per user what the squared error of any vector on its test rows needs: n, sum r^2, sum r m, sum m m'."""
    squares = F.sum(F.col(rating) * F.col(rating)).alias("sum_rr")
    return gram_sums(test.where(F.col(user).isNotNull()), user, vector, F.col(rating), size, more=[squares])


test_moments.__test__ = False


def squared_error(vec: Column, size: int) -> Column:
    """Summed squared error of a user vector from its `test_moments`, unrolled so that it compiles into the stage."""
    v = [F.get(vec, F.lit(i)) for i in range(size)]
    total = lambda terms: reduce(add, terms, F.lit(0.0))
    rows = [total(F.get("gram", F.lit(i * size + j)) * v[j] for j in range(size)) for i in range(size)]
    along = total(v[i] * F.get("rhs", F.lit(i)) for i in range(size))
    return F.col("sum_rr") - 2 * along + total(v[i] * rows[i] for i in range(size))


def grid_search(train, test, users, user, order, vector, rating, size, rates, regs, slice_by) -> DataFrame:
    """Test MSE of every (learning rate, regularisation), best first."""
    params = [(lr, reg) for lr in rates for reg in regs]
    fitted = sgd_fold(train, users, user, order, vector, rating, params, slice_by)
    scored = fitted.join(test_moments(test, user, vector, rating, size), user)
    sums = scored.groupBy("lr", "reg").agg(F.sum(squared_error(F.col("user_vec"), size)).alias("_s"), F.sum("n").alias("n"))
    return sums.select("lr", "reg", "n", (F.col("_s") / F.col("n")).alias("mse")).orderBy("mse", "lr", "reg")


def learning_curve(
    events, test, users, user, order, vector, rating, size, every: int, lr: float, reg: float, block_rows: int = 1_024, fan: int = 1_024
):
    """Test MSE after each `every` updates, next to the MSE of the start vectors; checkpoint 0 is the state before any.

    Counts test rows of users that the events update. Updates are numbered over the
    whole table by range partitions, so a busy day splits, and those numbers are the
    slices of a user's history. The scan gives each user's vector before and after
    a checkpoint; the curve is the running sum of the error changes. Events without
    user, rating or vector are no updates.
    """
    whole = F.col(user).isNotNull() & F.col(vector).isNotNull() & F.col(rating).isNotNull()
    rows = events.where(whole)
    ranked = with_global_rank(rows, order, "_at", [user, vector, rating])
    step = F.ceil(F.col("_at") / every).cast("long")
    slices = F.floor((F.col("_at") - 1) / 65_536).cast("long")
    moved = fold_scan(ranked, users, user, "_at", vector, rating, [(lr, reg)], slices, "user_vec", step, block_rows, fan, staged=True)
    moments = stage(test_moments(test, user, vector, rating, size))  # read for the changes and for the start
    scored = moved.join(moments, user)
    change = squared_error(F.col("_after"), size) - squared_error(F.col("_before"), size)
    per_step = scored.select(F.col("_tag").alias("checkpoint"), change.alias("_change")).groupBy("checkpoint").agg(F.sum("_change").alias("_change"))

    updated = users.join(ranked.select(user), user, "left_semi").join(moments, user)
    start = updated.agg(F.sum(squared_error(F.col("user_vec"), size)).alias("_start"), F.sum("n").alias("_n"))
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.max(step), F.lit(0).cast("long")))).alias("checkpoint")
    spine = ranked.agg(steps)
    every_step = spine.join(per_step, "checkpoint", "left").select("checkpoint", F.coalesce("_change", F.lit(0.0)).alias("_change"))
    slice_of = F.floor(F.col("checkpoint") / 100_000).cast("long")
    curve = with_running(every_step, None, "checkpoint", slice_of, {"_total": ("sum", F.col("_change"))})
    first, n = start.select("_start").scalar(), start.select("_n").scalar()
    return curve.select("checkpoint", ((first + F.col("_total")) / n).alias("mse"), (first / n).alias("fixed_mse"))
