"""Refits under one budget for loss curves of any shape."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from freshness.operators.ordered import with_global_rank
from freshness.session import stage


def _combined(a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Least summed loss of two curves for each total from 0 to `cap`."""
    if len(a) < len(b):
        a, b = b, a
    out = np.full(min(len(a) + len(b) - 1, cap + 1), np.inf)
    for i, loss in enumerate(b[: len(out)]):
        if np.isfinite(loss):
            part = a[: len(out) - i] + loss
            np.minimum(out[i : i + len(part)], part, out=out[i : i + len(part)])
    return out


def _curves(group: pd.DataFrame) -> list[np.ndarray]:
    return [np.asarray(c, dtype=float) for c in group.sort_values("_id")["_curve"]]


def _merge(cap: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        curves = _curves(group)
        total = curves[0]
        for curve in curves[1:]:
            total = _combined(total, curve, cap)
        return pd.DataFrame({"_id": [int(group["_parent"].iloc[0])], "_curve": [total]})

    return run


def _share(cap: int):
    """Split the budget of a node among its members; where two splits cost the same, earlier members get more."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        curves, left = _curves(group), int(group["_given"].iloc[0])
        before = [curves[0]]
        for curve in curves[1:-1]:
            before.append(_combined(before[-1], curve, cap))
        given = []
        for i in range(len(curves) - 1, 0, -1):
            own, rest = curves[i], before[i - 1]
            most = min(len(own) - 1, left)
            least = max(0, left - len(rest) + 1)
            costs = own[least : most + 1] + rest[left - np.arange(least, most + 1)]
            take = least + int(np.argmin(costs))
            given.append(take)
            left -= take
        given.append(left)
        return pd.DataFrame({"_id": np.sort(group["_id"].to_numpy()), "_own": given[::-1]})

    return run


def allocate_fits_any(loss: DataFrame, key: str, fits: str, loss_col: str, max_fits: int, fan: int = 32) -> DataFrame:
    """Fits per key with least total loss, with at most `max_fits` on top of every key's least number; exact for any curve.

    A greedy choice by saved loss misses a key whose second fit saves more than
    its first. Here curves are combined (least sum over all splits) in a tree of
    `fan` members a node, level by level as grouped jobs, and the budget is handed
    back down the same tree. A node holds `fan` curves of at most max_fits + 1
    numbers, however many keys there are; the driver sees one number, the count of
    keys. The root uses the smallest budget with least loss.

    Gaps in a curve are fit counts that cannot be chosen. Of repeated rows the
    smaller loss counts; rows without key, fits or loss (or with NaN) are left
    out. No rows give no rows. Between splits of one cost the key that comes first gets more.
    """
    rows = loss.where(F.col(key).isNotNull() & F.col(fits).isNotNull() & F.col(loss_col).isNotNull() & ~F.isnan(F.col(loss_col).cast("double")))
    least = rows.groupBy(key).agg(F.min(fits).alias("_least"))
    extra = (F.col(fits) - F.col("_least")).cast("long")
    near = rows.join(least, key).select(key, "_least", extra.alias("_x"), F.col(loss_col).cast("double").alias("_loss"))
    points = F.map_from_entries(F.collect_list(F.struct("_x", "_loss")))
    best = near.where(F.col("_x") <= max_fits).groupBy(key, "_least", "_x").agg(F.min("_loss").alias("_loss"))
    listed = best.groupBy(key, "_least").agg(points.alias("_points"), F.max("_x").alias("_last"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_last")), lambda i: F.coalesce(F.try_element_at("_points", i), F.lit(float("inf"))))
    numbered = with_global_rank(listed.select(key, "_least", dense.alias("_curve")), [F.col(key)], "_rank")
    leaves = stage(numbered.withColumn("_id", F.col("_rank") - 1).withColumn("_parent", F.floor(F.col("_id") / fan).cast("long")))

    count, levels = leaves.count(), [leaves.select("_id", "_parent", "_curve")]
    while count > 1:
        merged = levels[-1].groupBy("_parent").applyInPandas(_merge(max_fits), "_id long, _curve array<double>")
        levels.append(stage(merged.withColumn("_parent", F.floor(F.col("_id") / fan).cast("long"))))
        count = -(-count // fan)
    position = F.array_position("_curve", F.array_min("_curve")) - 1
    given = levels[-1].select("_id", position.cast("long").alias("_own"))
    for level in reversed(levels[:-1]):
        asked = level.join(given.select(F.col("_id").alias("_parent"), F.col("_own").alias("_given")), "_parent")
        given = stage(asked.groupBy("_parent").applyInPandas(_share(max_fits), "_id long, _own long"))
    return leaves.join(given, "_id").select(key, (F.col("_least") + F.col("_own")).alias("n_fits"))
