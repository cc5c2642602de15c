"""Count windows, rolling values, lags, top-k, unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from freshness.operators.joins import count_before
from freshness.operators.ordered import columns, names, with_frames, with_row_number, with_running


def count_windows(df, key, order, value: str, size: int, slide, slice_by, rn: str | None = None) -> DataFrame:
    """Per key: the last `size` values each time `slide` new ones arrived.

    A row is sent to each of the about size / slide windows that hold it, and the
    window is collected from at most `size` rows. `slide` is a number or a
    column. Gives key, window (0-based), end_rn, last_order, values.
    """
    key, order = names(key), columns(order)
    slide = F.lit(slide) if isinstance(slide, int) else slide
    placed = df if rn else with_row_number(df, key, order, slice_by, "_rn")
    rn = rn or "_rn"
    first = F.greatest(F.lit(0), F.ceil((F.col(rn) - size) / slide)).cast("long")
    last = F.floor((F.col(rn) - 1) / slide).cast("long")
    # With slide > size some rows fall between windows and belong to none.
    spread = placed.where(first <= last).withColumn("window", F.explode(F.sequence(first, last)))
    packed = F.struct(F.col(rn).alias("rn"), F.col(value).alias("v"))
    lists = spread.groupBy(*key, "window").agg(
        F.sort_array(F.collect_list(packed)).alias("_l"),
        F.max(rn).alias("end_rn"),
        F.max(F.struct(*order)).alias("last_order"),
    )
    return lists.where(F.size("_l") == size).select(*key, "window", "end_rn", "last_order", F.col("_l.v").alias("values"))


def count_windows_per_key(df, key, order, value: str, size: int, slides: DataFrame, slice_by) -> DataFrame:
    """`count_windows` with the slide of each key taken from (key, slide)."""
    return count_windows(df.join(slides, names(key)), key, order, value, size, F.col("slide"), slice_by)


def rolling(df, key, order, col: str, n: int, how: str, slice_by, name: str = "rolled", block_rows: int = 65_536):
    """Rolling sum, avg or max over n rows; null until n rows exist."""
    placed = with_row_number(df, key, order, slice_by, "_rn")
    framed = with_frames(
        placed, key, "_rn", n - 1, 0, {name: lambda w: getattr(F, how)(col).over(w.rowsBetween(-(n - 1), 0))}, block_rows
    )
    return framed.withColumn(name, F.when(F.col("_rn") >= n, F.col(name))).drop("_rn")


def inter_arrival(df, key, ts: str, order, slice_by) -> DataFrame:
    """Gap to the key's previous row (time as a number), and the key's mean gap."""
    t = F.col(ts)
    out = with_running(
        df, key, order, slice_by,
        {"_prev": ("previous", t)},
        {"_first": ("min", t), "_last": ("max", t), "_n": ("count", t)},
    )
    mean = (F.col("_last") - F.col("_first")) / F.nullif(F.col("_n") - 1, F.lit(0))
    return out.withColumn("gap", t - F.col("_prev")).withColumn("mean_gap", mean).drop("_prev", "_first", "_last", "_n")


def uniform_draw(ids, seed: int) -> Column:
    """A number in (0, 1) fixed by the row's ids and the seed, the same on every evaluation."""
    return (F.pmod(F.xxhash64(*columns(ids), F.lit(seed)), F.lit(2**52)) + F.lit(0.5)) / F.lit(float(2**52))


def redraw_arrivals(df, ts: str, order, ids, dist: str, seed: int, slice_by, name: str = "new_ts") -> DataFrame:
    """Times redrawn as start + running sum of exponential or gaussian gaps with the original mean."""
    ends = df.agg(F.struct(F.min(ts).alias("a"), F.max(ts).alias("b"), F.count(ts).alias("n"))).scalar()
    mean = (ends["b"] - ends["a"]) / (ends["n"] - 1)
    u = uniform_draw(ids, seed)
    if dist == "exponential":
        gap = -F.log(u) * mean
    elif dist == "gaussian":
        gap = mean + F.sqrt(-2 * F.log(u)) * F.cos(F.lit(6.283185307179586) * uniform_draw(ids, seed + 1))
    else:
        raise ValueError(f"unknown distribution {dist!r}")
    drawn = df.withColumn("_gap", gap)
    summed = with_running(
        drawn, None, order, slice_by, {"_sum": ("sum", F.col("_gap"))}, {"_skip": ("first", F.col("_gap"))}
    )
    start = ends["a"]
    return summed.withColumn(name, start + F.col("_sum") - F.col("_skip")).drop("_gap", "_sum", "_skip")


def staleness(query_ts, feature_ts) -> Column:
    """Query time minus feature time, in seconds for timestamps."""
    q, f = columns([query_ts, feature_ts])
    return (F.unix_micros(q.cast("timestamp")) - F.unix_micros(f.cast("timestamp"))) / 1e6


def pending_and_past(events, updates, key, ts, slice_by=None) -> DataFrame:
    """For each event: events of the key since its last update (with this one), and those before it."""
    return count_before(events, events, updates, key, ts, slice_by)


def error_lags(err, key, order, error: str, w: int, offset: int, slice_by, block_rows: int = 65_536) -> DataFrame:
    """The last w errors as lag_1..lag_w and the error `offset` steps ahead as `label`; full rows only."""
    placed = with_row_number(err, key, order, slice_by, "_rn")
    exprs = {f"lag_{i}": (lambda win, i=i: F.lag(error, i).over(win)) for i in range(1, w + 1)}
    exprs["label"] = lambda win: F.lead(error, offset).over(win)
    framed = with_frames(placed, key, "_rn", w, offset, exprs, block_rows).drop("_rn")
    return framed.na.drop(subset=list(exprs))


def window_error(p, key, order, w: int, slice_by) -> DataFrame:
    """Mean squared error of every block of w rows of a key."""
    placed = with_row_number(p, key, order, slice_by, "_rn")
    block = F.floor((F.col("_rn") - 1) / w).cast("long").alias("block")
    sq = F.pow(F.col("y_pred") - F.col("y_true"), 2)
    return placed.groupBy(*names(key), block).agg(F.avg(sq).alias("mse"), F.count(F.lit(1)).alias("n"))


def update_curve(updates, key, order, slice_by, name: str = "n_so_far") -> DataFrame:
    """Running number of updates of each key and policy over time."""
    return with_row_number(updates, names(key) + ["policy"], order, slice_by, name)


def change_spans(marks: DataFrame, key, pos: str, slice_by) -> DataFrame:
    """Runs of consecutive changed positions as (start, end). `marks` holds the changed positions only."""
    placed = with_row_number(marks, key, pos, slice_by, "_rn")
    run = (F.col(pos) - F.col("_rn")).alias("_run")
    spans = placed.groupBy(*names(key), run).agg(F.min(pos).alias("start_pos"), F.max(pos).alias("end_pos"))
    return spans.drop("_run")


def latest_per_key(df, key, order) -> DataFrame:
    """The newest row of each key, found by partial aggregation."""
    key = names(key)
    rest = [c for c in df.columns if c not in key]
    newest = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*columns(order))).alias("_r"))
    return newest.select(*key, "_r.*")


def dedupe_first(df, key, order) -> DataFrame:
    """The first row of each key in a defined order."""
    key = names(key)
    rest = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*columns(order))).alias("_r"))
    return first.select(*key, "_r.*")


def top_users(df, key, n: int) -> DataFrame:
    """The n keys with most rows; ties go to the lower key."""
    counts = df.groupBy(*names(key)).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), *names(key)).limit(n)


def hottest_columns(heat: DataFrame, policy: str, key: str, n: int) -> DataFrame:
    """The n keys one policy updated most, numbered from 1."""
    top = heat.orderBy(F.desc(policy), key).limit(n)
    return top.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(policy), key)))


def order_events(df, order, path: str | None = None) -> DataFrame:
    """Rows in the given order; with `path` written as sorted Parquet files."""
    if path is None:
        return df.orderBy(*columns(order))
    df.repartitionByRange(*columns(order)).sortWithinPartitions(*columns(order)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def every_nth(df, key, order, per_key: int, slice_by) -> DataFrame:
    """Evenly spaced rows, about `per_key` of each key."""
    placed = with_running(df, key, order, slice_by, {"_rn": ("count", F.lit(1))}, {"_n": ("count", F.lit(1))})
    interval = F.greatest(F.floor(F.col("_n") / per_key), F.lit(1))
    return placed.where((F.col("_rn") - 1) % interval == 0).drop("_rn", "_n")


def tagged_union(parts: list[tuple[DataFrame, dict]]) -> DataFrame:
    """Tables stacked by column name, each with its parameters as columns."""
    tagged = [df.withColumns({n: F.lit(v) for n, v in params.items()}) for df, params in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def rows_in_one_side(a: DataFrame, b: DataFrame, cols) -> DataFrame:
    """Value combinations that occur exactly once in the stacked pair."""
    both = a.select(*names(cols)).unionByName(b.select(*names(cols)))
    return both.groupBy(*names(cols)).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
