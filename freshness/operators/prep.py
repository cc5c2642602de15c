"""Projections, filters, time re-basing and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from freshness.functions.scalars import clip, minute_index  # noqa: F401  (same section of the API)
from freshness.operators.ordered import (
    exact_quantiles, names, width_slice, with_global_rank, with_row_number, with_running,
)
from freshness.session import stage


def time_bucket(df: DataFrame, ts: str, factor: float, name: str = "bucket") -> DataFrame:
    """Whole number of `factor`-long steps since the first time of the table."""
    start = df.agg(F.min(ts)).scalar()
    return df.withColumn(name, F.floor((F.col(ts) - start) / F.lit(factor)).cast("long"))


def rebase_per_key(df: DataFrame, key, ts: str, unit: float, slice_by, name: str = "rebased") -> DataFrame:
    """Time since the key's first row, in units."""
    out = with_running(df, key, ts, slice_by, totals={"_first": ("min", F.col(ts))})
    return out.withColumn(name, (F.col(ts) - F.col("_first")) / F.lit(unit)).drop("_first")


def squash_rows(df: DataFrame, order, n: int, slice_by=None, name: str = "step") -> DataFrame:
    """Time replaced by row index // n over the whole table.

    Without `slice_by` the order is split by range partitioning.
    """
    placed = with_row_number(df, None, order, slice_by, "_rn") if slice_by is not None else with_global_rank(df, order, "_rn")
    return placed.withColumn(name, F.floor((F.col("_rn") - 1) / n).cast("long")).drop("_rn")


def assign_query_time(df: DataFrame, index: str, start: float, step: float, name: str = "query_time") -> DataFrame:
    """Wall time = index x step + start."""
    return df.withColumn(name, F.col(index) * F.lit(step) + F.lit(start))


def zscore_filter(df: DataFrame, col: str, k: float = 3.0) -> DataFrame:
    """Rows within k population standard deviations of the mean."""
    m = df.agg(F.struct(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"))).scalar()
    return df.where(F.abs((F.col(col) - m["mean"]) / m["std"]) < k)


def complete_keys(df: DataFrame, key, min_rows: int | None = None) -> DataFrame:
    """Rows of keys with at least `min_rows` rows, or with the highest row count."""
    key = names(key)
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    least = F.lit(min_rows) if min_rows is not None else counts.agg(F.max("_n")).scalar()
    return df.join(counts.where(F.col("_n") >= least), key, "left_semi")


def aligned_keys(df: DataFrame, key, ts: str, start, min_rows: int) -> DataFrame:
    """Rows of keys whose series starts at `start` and is long enough."""
    key = names(key)
    spans = df.groupBy(*key).agg(F.min(ts).alias("_first"), F.count(F.lit(1)).alias("_n"))
    return df.join(spans.where((F.col("_first") == start) & (F.col("_n") >= min_rows)), key, "left_semi")


def prefix_rows(results: DataFrame, updates: DataFrame, order, ts: str, limit: int, slice_by) -> tuple[DataFrame, DataFrame]:
    """The first `limit` results, and the updates made before the last of them."""
    head = with_row_number(results, None, order, slice_by, "_rn").where(F.col("_rn") <= limit).drop("_rn")
    last = head.agg(F.max(ts)).scalar()
    return head, updates.where(F.col(ts) < last)


def skip_warmup(df: DataFrame, key, order, n: int, slice_by) -> DataFrame:
    """Without the first n rows of each key."""
    return with_row_number(df, key, order, slice_by, "_rn").where(F.col("_rn") > n).drop("_rn")


def burst_rows(df: DataFrame, step: str, threshold: int) -> DataFrame:
    """Rows in steps with more than `threshold` rows."""
    busy = df.groupBy(step).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > threshold)
    return df.join(busy, step, "left_semi")


def split_seen(df: DataFrame, keys: DataFrame, key) -> tuple[DataFrame, DataFrame]:
    """Rows of known keys, and the rest."""
    known = keys.select(*names(key)).distinct()
    return df.join(known, names(key), "left_semi"), df.join(known, names(key), "left_anti")


def implicit_label(rating: str | Column, above: float = 3.0) -> Column:
    """1 when the explicit rating is above the threshold, else 0."""
    rating = F.col(rating) if isinstance(rating, str) else rating
    return F.when(rating > above, 1).otherwise(0)


def drop_incomplete(df: DataFrame, cols) -> DataFrame:
    """Without rows that lack one of the values."""
    return df.na.drop(subset=names(cols))


def map_labels(df: DataFrame, col: str, mapping: dict[str, str], name: str = "label") -> DataFrame:
    """Display names from a constant mapping; unknown values are kept as they are."""
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn(name, F.coalesce(F.element_at(pairs, F.col(col)), F.col(col)))


def quantile_split(df: DataFrame, ts: str, q: float, slice_by=None) -> tuple[DataFrame, DataFrame]:
    """Rows at or below the exact time quantile, and rows above it. The rows are written once, as they are read three times."""
    df = stage(df)
    cut = exact_quantiles(df, ts, {"_cut": q}, slice_by=slice_by).scalar()
    return df.where(F.col(ts) <= cut), df.where(F.col(ts) > cut)


def median_split(df: DataFrame, ts: str, slice_by=None) -> tuple[DataFrame, DataFrame]:
    """Rows strictly below and strictly above the median; rows at the median drop out. The rows are written once, as they are read three times."""
    df = stage(df)
    cut = exact_quantiles(df, ts, {"_cut": 0.5}, slice_by=slice_by).scalar()
    return df.where(F.col(ts) < cut), df.where(F.col(ts) > cut)


def per_key_half_split(df: DataFrame, key, order, slice_by, name: str = "part") -> DataFrame:
    """Mark the first ceil(n / 2) rows of each key as train, the rest as stream."""
    placed = with_running(df, key, order, slice_by, {"_rn": ("count", F.lit(1))}, {"_n": ("count", F.lit(1))})
    part = F.when(F.col("_rn") - 1 < F.col("_n") / 2, "train").otherwise("stream")
    return placed.withColumn(name, part).drop("_rn", "_n")


def sample_keys(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Rows of n keys drawn by a hash of (key, seed); repeatable."""
    drawn = df.select(key).distinct().orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
    return df.join(drawn, key, "left_semi")


def dense_ids(df: DataFrame, col: str, name: str = "idx", width: int | None = None) -> DataFrame:
    """Each distinct value with its 0-based position in sorted order.

    `width` slices an integer column by value; other types are range partitioned.
    """
    keys = df.select(col).where(F.col(col).isNotNull()).distinct()
    ranked = with_row_number(keys, None, col, width_slice(col, width), name) if width else with_global_rank(keys, col, name)
    return ranked.withColumn(name, F.col(name) - 1)


def train_test_rows(df: DataFrame, frac: float, seed: int, on) -> tuple[DataFrame, DataFrame]:
    """Row split by a hash of the row's own columns, the same on every run."""
    bucket = F.pmod(F.xxhash64(*names(on), F.lit(seed)), F.lit(1_000_000))
    cut = int(frac * 1_000_000)
    return df.where(bucket < cut), df.where(bucket >= cut)
