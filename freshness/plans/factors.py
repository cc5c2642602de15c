"""Section 2.8, first part: factor vectors."""

from pyspark.sql import functions as F

from freshness.operators import factors as X
from freshness.operators.ordered import day_slice
from freshness.plans.registry import query
from freshness.plans.tables import ITEMS, RANK, RATING_ORDER, RATING_ORDER_SQL, RATINGS, USERS
from freshness.session import stage

LR, REG = 0.05, 0.01
SPLIT = "1999-06-01"
FACTORS, ROUNDS = 50, 50  # of the alternation, as in the original workbench


def rated(t):
    """Ratings with the stand-in item vectors."""
    return t.ratings.join(t.items, "item_id")


def stored_ratings(t):
    """Ratings, joined once for both halves."""
    return stage(t.ratings.select("user_id", "item_id", "rating", "ts"))


def halves(df):
    return df.where(f"ts < TIMESTAMP_NTZ '{SPLIT}'"), df.where(f"ts >= TIMESTAMP_NTZ '{SPLIT}'")


def _flat(df, key, vec):
    """Vectors as one row per value, for comparison."""
    return df.select(key, F.posexplode_outer(vec).alias("i", "x"))


@query("gram_sums", f"""WITH {RATINGS}, {ITEMS},
m AS (SELECT user_id, rating, unnest(item_vec) AS x, unnest(range(8)) AS i, item_vec FROM ratings JOIN items USING (item_id)),
mm AS (SELECT user_id, rating, x, i, unnest(item_vec) AS y, unnest(range(8)) AS j FROM m)
SELECT user_id, CAST(i * 8 + j AS INTEGER) AS cell, round(sum(x * y), 8) AS gram, round(sum(x * rating) FILTER (j = 0), 8) AS rhs FROM mm GROUP BY user_id, i, j""")
def _(t):
    sums = X.gram_sums(rated(t), "user_id", "item_vec", F.col("rating"), RANK)
    cells = sums.select("user_id", "rhs", F.posexplode("gram").alias("cell", "gram"))
    rhs = F.when(F.col("cell") % RANK == 0, F.get("rhs", F.floor(F.col("cell") / RANK).cast("int")))
    return cells.select("user_id", "cell", F.round("gram", 8).alias("gram"), F.round(rhs, 8).alias("rhs"))


@query("sgd_fold", f"""WITH RECURSIVE {RATINGS}, {ITEMS}, {USERS},
ev AS (SELECT user_id, rating, item_vec, row_number() OVER (PARTITION BY user_id ORDER BY {RATING_ORDER_SQL}) AS rn FROM ratings JOIN items USING (item_id)),
fold AS (
  SELECT user_id, CAST(0 AS BIGINT) AS rn, user_vec AS u FROM users
  UNION ALL
  SELECT f.user_id, e.rn, list_transform(list_zip(f.u, e.item_vec), lambda p: p[1] + {LR}::DOUBLE * ((e.rating - list_dot_product(f.u, e.item_vec)) * p[2] - {REG}::DOUBLE * p[1]))
  FROM fold f JOIN ev e ON f.user_id = e.user_id AND e.rn = f.rn + 1),
final AS (SELECT user_id, arg_max(u, rn) AS u FROM fold GROUP BY user_id HAVING max(rn) > 0)
SELECT user_id, CAST(unnest(range(8)) AS INTEGER) AS i, round(unnest(u), 8) AS x FROM final""")
def _(t):
    out = X.sgd_fold(rated(t), t.users, "user_id", RATING_ORDER, "item_vec", "rating", [(LR, REG)], day_slice("ts"))
    return _flat(out, "user_id", "user_vec").withColumn("x", F.round("x", 8))


@query("ridge_fold_in")
def _(t):
    return _flat(X.ridge_fold_in(rated(t), "user_id", "item_vec", "rating", RANK - 1), "user_id", "user_vec")


@query("normal_eq_fold_in")
def _(t):
    return _flat(X.normal_eq_fold_in(rated(t), "user_id", "item_vec", "rating", RANK, 10.0), "user_id", "user_vec")


@query("implicit_fold_in")
def _(t):
    liked = t.ratings.where("rating > 3").select("user_id", "item_id")
    out = X.implicit_fold_in(liked, t.items, "user_id", "item_id", "item_vec", RANK, 40.0, 0.1)
    return _flat(out, "user_id", "user_vec")


@query("als_train")
def _(t):
    model = X.als_train(t.ratings, "user_id", "item_id", "rating")
    return _flat(model.userFactors, "id", "features")


@query("als_train_implicit")
def _(t):
    model = X.als_train_implicit(t.ratings.where("rating > 3"), "user_id", "item_id")
    return _flat(model.itemFactors, "id", "features")


@query("recommend")
def _(t):
    model = X.als_train(t.ratings, "user_id", "item_id", "rating")
    return X.recommend(model, t.users.select(F.col("user_id").cast("int")), 5)


@query("rating_rmse")
def _(t):
    train, test = halves(stored_ratings(t))
    model = X.als_train(train, "user_id", "item_id", "rating")
    return X.rating_rmse(model, test, "rating")


@query("oracle_factors")
def _(t):
    model = X.oracle_factors(*halves(stored_ratings(t)), "user_id", "item_id", "rating")
    return _flat(model.userFactors, "id", "features")


@query("ridge_alternate")
def _(t):
    users, items = X.ridge_alternate(t.ratings, "user_id", "item_id", "rating", FACTORS, ROUNDS)
    return _flat(users, "user_id", "user_vec")


@query("sgd_both")
def _(t):
    users, _items = X.sgd_both(t.ratings, t.users.select("user_id", "user_vec"), t.items, "user_id", "item_id", "rating", RANK, 0.1, 0.01, 2)
    return _flat(users, "user_id", "user_vec")


# The fold, event by event, for each (lr, reg) of `params`; keeps a version per user and checkpoint `c` of the event.
FOLDED = f"""{RATINGS}, {ITEMS}, {USERS},
rated AS (SELECT * FROM ratings JOIN items USING (item_id)),
test AS (SELECT user_id, rating, item_vec FROM rated WHERE ts >= TIMESTAMP '{SPLIT}'),
train AS (SELECT *, row_number() OVER (ORDER BY {RATING_ORDER_SQL}) AS g FROM rated WHERE ts < TIMESTAMP '{SPLIT}'),
ev AS (SELECT user_id, rating, item_vec, CAST(ceil(g / {{every}}) AS BIGINT) AS c, row_number() OVER (PARTITION BY user_id ORDER BY g) AS rn FROM train),
params AS ({{params}}),
fold AS (
  SELECT user_id, lr, reg, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS c, user_vec AS u FROM users, params WHERE user_id IN (SELECT user_id FROM ev)
  UNION ALL
  SELECT f.user_id, lr, reg, e.rn, e.c, list_transform(list_zip(f.u, e.item_vec), lambda p: p[1] + lr * ((e.rating - list_dot_product(f.u, e.item_vec)) * p[2] - reg * p[1]))
  FROM fold f JOIN ev e ON f.user_id = e.user_id AND e.rn = f.rn + 1)"""
EVERY = 1_000
RATES, REGS = [1e-3, 1e-2, 1e-1, 2e-1, 2e-2], [1e-2, 1e-1, 2e-1, 2e-2]
GRID = f"SELECT unnest({RATES})::DOUBLE AS lr, reg FROM (SELECT unnest({REGS})::DOUBLE AS reg)"


@query("grid_search", f"""WITH RECURSIVE {FOLDED.format(every=EVERY, params=GRID)},
final AS (SELECT user_id, lr, reg, arg_max(u, rn) AS u FROM fold GROUP BY ALL)
SELECT lr, reg, count(*) AS n, round(avg((rating - list_dot_product(u, item_vec)) ** 2), 8) AS mse FROM final JOIN test USING (user_id) GROUP BY lr, reg""")
def _(t):
    train, test = halves(rated(t))
    out = X.grid_search(train, test, t.users, "user_id", RATING_ORDER, "item_vec", "rating", RANK, RATES, REGS, day_slice("ts"))
    return out.withColumn("mse", F.round("mse", 8))


@query("learning_curve", f"""WITH RECURSIVE {FOLDED.format(every=EVERY, params=f"SELECT {LR}::DOUBLE AS lr, {REG}::DOUBLE AS reg")},
versions AS (SELECT user_id, c, arg_max(u, rn) AS u FROM fold GROUP BY ALL),
errors AS (SELECT user_id, c, sum((rating - list_dot_product(u, item_vec)) ** 2) AS e, count(*) AS n FROM versions JOIN test USING (user_id) GROUP BY ALL),
changes AS (SELECT c, n, e - lag(e, 1, 0) OVER (PARTITION BY user_id ORDER BY c) AS d FROM errors),
curve AS (SELECT c, sum(d) AS d FROM (SELECT c, d FROM changes UNION ALL SELECT unnest(range(0, (SELECT max(c) FROM ev) + 1)), 0) GROUP BY c),
total AS (SELECT sum(n) AS n, sum(d) AS start FROM changes WHERE c = 0)
SELECT c AS checkpoint, round(sum(d) OVER (ORDER BY c) / n, 8) AS mse, round(start / n, 8) AS fixed_mse FROM curve, total""")
def _(t):
    train, test = halves(rated(t))
    out = X.learning_curve(train, test, t.users, "user_id", RATING_ORDER, "item_vec", "rating", RANK, EVERY, LR, REG)
    return out.select("checkpoint", F.round("mse", 8).alias("mse"), F.round("fixed_mse", 8).alias("fixed_mse"))
