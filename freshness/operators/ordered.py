"""Ordered computations per key that never put a whole key into one task.

A plain `Window.partitionBy(key)` sends every row of a key to one task, so a key
that holds a third of the table holds a third of the job. Here rows are grouped
by (key, slice) instead. A slice is a stretch of the order: an hour, a number
range, or a range partition. Each slice is scanned on its own, slice totals are
pre-aggregated before their shuffle, and the running total of the earlier slices
is added back with a join on the same (key, slice) partitioning, so the wide
rows are shuffled once. Slices with no rows do not exist and cost nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from freshness.session import stage

_FIRST_SLICE = -(2**62)


def names(cols: str | Sequence[str] | None) -> list[str]:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def columns(cols) -> list[Column]:
    cols = [cols] if isinstance(cols, (str, Column)) else list(cols)
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def day_slice(ts: str | Column) -> Column:
    """Days since 1970, also for zone-less timestamps."""
    return F.unix_date(F.to_date(ts)).cast("long")


def hour_slice(ts: str | Column) -> Column:
    """Hours since 1970 in the wall clock of `ts`; never decreases as `ts` grows."""
    return day_slice(ts) * 24 + F.hour(ts)


def width_slice(value: str | Column, width: float) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value / F.lit(width)).cast("long")


def range_slices(df: DataFrame, order) -> DataFrame:
    """Add `_slice` by range partitioning on the whole order, for orders whose
    spread is unknown. Holds up when one value makes up most rows, as later
    order columns split it. Staged, since range bounds come from a sample."""
    ranged = df.repartitionByRange(*columns(order))
    return stage(ranged.withColumn("_slice", F.spark_partition_id().cast("long")))


def _slice_total(kind: str, value: Column, order: list[Column]) -> Column:
    if kind == "count":
        return F.count(value)
    if kind in ("sum", "min", "max"):
        return getattr(F, kind)(value)
    position = F.when(value.isNotNull(), F.struct(*order))
    if kind in ("last", "previous"):
        return F.max_by(value, position)
    if kind == "first":
        return F.min_by(value, position)
    raise ValueError(f"unknown running aggregate {kind!r}")


def _running(kind: str, value: Column, frame) -> Column:
    if kind == "previous":
        return F.lag(value).over(frame)
    if kind == "last":
        return F.last(value, ignorenulls=True).over(frame)
    if kind == "first":
        return F.first(value, ignorenulls=True).over(frame)
    return getattr(F, kind)(value).over(frame)


def _combine(kind: str, local: Column, carried: Column) -> Column:
    if kind == "count":
        return local + F.coalesce(carried, F.lit(0))
    if kind == "sum":
        return F.coalesce(local + carried, local, carried)
    if kind == "min":
        return F.least(local, carried)
    if kind == "max":
        return F.greatest(local, carried)
    return F.coalesce(carried, local) if kind == "first" else F.coalesce(local, carried)


def with_running(
    df: DataFrame,
    key: str | Sequence[str] | None,
    order,
    slice_by: str | Column,
    running: Mapping[str, tuple[str, Column]] | None = None,
    totals: Mapping[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Add running values (rows up to and including this one) and key totals.

    `running` and `totals` map a new column to (kind, value) with kind one of
    count, sum, min, max, first, last; nulls are skipped as in SQL aggregates.
    `previous` (running only) is the value one row back; wrap values that can be
    null in a struct.
    `slice_by` must never decrease along `order`. Rows with a null key form one
    sequence, as in a SQL window. With no key the whole table is one sequence and only slice totals meet in one task.
    """
    key, order = names(key), columns(order)
    running, totals = dict(running or {}), dict(totals or {})
    slice_by = F.col(slice_by) if isinstance(slice_by, str) else slice_by
    # a struct of the key equals itself even where a field is null, in groups, windows and joins alike
    parts = ["_key", "_slice"] if key else ["_slice"]
    rows = (df.withColumn("_key", F.struct(*key)) if key else df).withColumn("_slice", F.coalesce(slice_by.cast("long"), F.lit(_FIRST_SLICE)))

    wanted = {**{f"_r_{n}": s for n, s in running.items()}, **{f"_t_{n}": s for n, s in totals.items()}}
    per_slice = rows.groupBy(*parts).agg(*[_slice_total(k, v, order).alias(n) for n, (k, v) in wanted.items()])

    whole = W.partitionBy("_key") if key else W.partitionBy(F.lit(0))
    by_slice = whole.orderBy("_slice")
    earlier = by_slice.rowsBetween(W.unboundedPreceding, -1)
    everything = by_slice.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    merge = {"count": "sum", "previous": "last"}
    carried = per_slice.select(
        *parts,
        *[_running(merge.get(k, k), F.col(f"_r_{n}"), earlier).alias(f"_c_{n}") for n, (k, _) in running.items()],
        *[_running(merge.get(k, k), F.col(f"_t_{n}"), everything).alias(n) for n, (k, _) in totals.items()],
    )

    ordered = W.partitionBy(*parts).orderBy(*order)
    frame = ordered.rowsBetween(W.unboundedPreceding, 0)
    local = rows.select(
        "*",
        *[_running(k, v, ordered if k == "previous" else frame).alias(f"_l_{n}") for n, (k, v) in running.items()],
    )
    keep = [c for c in df.columns if c != "_slice" and c not in running and c not in totals]
    return local.join(carried, parts, "left").select(
        *keep,
        *[_combine(k, F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n, (k, _) in running.items()],
        *totals,
    )


def with_row_number(df: DataFrame, key, order, slice_by, name: str = "rn") -> DataFrame:
    """1-based position of each row within its key."""
    return with_running(df, key, order, slice_by, {name: ("count", F.lit(1))})


def with_global_rank(df: DataFrame, order, name: str = "rank", keep: Sequence[str] | None = None) -> DataFrame:
    """1-based position over the whole table; no task sees more than its range. `keep`: the columns that come with it (all).

    Rows are shuffled once, into sorted ranges that are staged with the place in their range; ranges before a row's own are
    added up from their counts, one number a range.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c != name]
    ranged = df.repartitionByRange(*columns(order)).sortWithinPartitions(*columns(order))
    placed = stage(ranged.select(*keep, F.monotonically_increasing_id().alias("_place")))  # the range above 33 bits, the row below
    at = F.shiftright("_place", 33)
    sizes = placed.groupBy(at.alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_range")) - F.col("_n")
    before = sizes.select(F.struct("_range", earlier.alias("_before")).alias("_r")).agg(F.map_from_entries(F.collect_list("_r"))).scalar()
    return placed.select(*keep, (F.element_at(before, at) + F.col("_place").bitwiseAND(F.lit(2**33 - 1)) + 1).alias(name))


def with_frames(
    df: DataFrame,
    key,
    rn: str,
    before: int,
    after: int,
    exprs: Mapping[str, Callable],
    block_rows: int = 65_536,
) -> DataFrame:
    """Window expressions that look at most `before` rows back and `after` ahead.

    Rows are blocked by position; the few rows near an edge are copied into the
    neighbour block, so each block is complete by itself. `exprs` maps a column
    to a function of the window (partitioned and ordered already).
    """
    key = names(key)
    reach = max(before, after)
    if block_rows <= reach:
        block_rows = reach + 1
    position = F.col(rn) - 1
    home = F.floor(position / block_rows).cast("long")
    first = F.floor((position - after) / block_rows).cast("long")
    last = F.floor((position + before) / block_rows).cast("long")
    copies = df.withColumn("_home", home).withColumn("_block", F.explode(F.sequence(first, last)))
    window = W.partitionBy(*key, "_block").orderBy(rn)
    framed = copies.select("*", *[build(window).alias(name) for name, build in exprs.items()])
    return framed.where("_block = _home").drop("_block", "_home")


def exact_quantiles(
    df: DataFrame, value: str, quantiles: Mapping[str, float], group=None, slice_by=None
) -> DataFrame:
    """Exact, linearly interpolated quantiles per group, as `percentile` gives.

    Counts equal values first, then finds the two neighbours of each wanted
    position from running counts, so no task holds all values of a group.
    Without `slice_by` (a never-decreasing function of `value`) the distinct
    values are range partitioned.
    """
    group = names(group)
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    if slice_by is None:
        counted, slice_by = range_slices(counted, group + [value]), "_slice"
    placed = with_running(
        counted, group, value, slice_by, {"_upto": ("sum", F.col("_n"))}, {"_total": ("sum", F.col("_n"))}
    )
    start = F.col("_upto") - F.col("_n")
    picks = []
    for name, q in quantiles.items():
        at = F.lit(q) * (F.col("_total") - 1)
        for side, spot in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (spot >= start) & (spot < F.col("_upto"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{side}_{name}"))
    found = placed.groupBy(*group).agg(F.max("_total").alias("_total"), *picks)
    out = []
    for name, q in quantiles.items():
        at = F.lit(q) * (F.col("_total") - 1)
        lo, hi = F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return found.select(*group, *out)

