"""Ordered primitives against brute force, with slices and blocks small enough to be crossed often."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshness.operators import ordered as O


@pytest.fixture(scope="module")
def rows():
    """One key holds most rows, and one moment of it holds many of those."""
    rng = np.random.default_rng(5)
    n = 600
    key = np.where(rng.random(n) < 0.6, 1, rng.integers(2, 20, n))
    t = np.where(rng.random(n) < 0.4, 50, rng.integers(0, 100, n))
    value = rng.integers(0, 30, n).astype(float)
    value[rng.random(n) < 0.1] = np.nan
    return pd.DataFrame({"key": key, "t": t, "id": np.arange(n), "value": value})


@pytest.fixture(scope="module")
def table(spark, rows):
    clean = rows.astype(object).where(rows.notna(), None)
    return spark.createDataFrame(clean.values.tolist(), "key LONG, t LONG, id LONG, value DOUBLE")


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_running_values(table, rows, width):
    v = F.col("value")
    out = O.with_running(
        table, "key", ["t", "id"], O.width_slice("t", width),
        {"n": ("count", F.lit(1)), "s": ("sum", v), "lo": ("min", v), "hi": ("max", v), "last": ("last", v), "first": ("first", v),
         "prev": ("previous", F.struct(v.alias("v")))},
        {"total": ("count", v)},
    ).withColumn("prev", F.col("prev.v")).toPandas().sort_values("id").reset_index(drop=True)
    want = rows.sort_values(["key", "t", "id"]).copy()
    g = want.groupby("key")["value"]
    want["n"] = want.groupby("key").cumcount() + 1
    want["s"] = want["value"].fillna(0).groupby(want["key"]).cumsum()
    seen = g.transform(lambda x: x.notna().cumsum()) > 0
    want["s"] = want["s"].where(seen)
    want["lo"] = g.transform(lambda x: x.expanding().min())
    want["hi"] = g.transform(lambda x: x.expanding().max())
    want["last"] = g.ffill()
    want["first"] = g.transform(lambda x: x.bfill().iloc[0] if x.notna().any() else np.nan).where(seen)
    want["prev"] = g.shift(1)
    want["total"] = g.transform("count")
    want = want.sort_values("id").reset_index(drop=True)
    for c in ("n", "s", "lo", "hi", "last", "first", "prev", "total"):
        np.testing.assert_allclose(out[c].astype(float), want[c].astype(float), err_msg=c)


def test_no_key_and_global_rank(table, rows):
    order = [F.col("value").desc_nulls_last(), F.col("id")]
    ranked = O.with_global_rank(table, order).toPandas().set_index("id")["rank"]
    want = rows.sort_values(["value", "id"], ascending=[False, True], na_position="last")["id"].tolist()
    assert [ranked[i] for i in want] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("block", [5, 64, 10_000])
def test_frames_cross_blocks(table, rows, block):
    placed = O.with_row_number(table, "key", ["t", "id"], O.width_slice("t", 10))
    out = O.with_frames(
        placed, "key", "rn", 4, 2,
        {"s": lambda w: F.sum("id").over(w.rowsBetween(-4, 2)), "l": lambda w: F.lag("id", 3).over(w), "d": lambda w: F.lead("id", 2).over(w)},
        block,
    ).toPandas()
    assert len(out) == len(rows)
    out = out.sort_values(["key", "rn"])
    for _, g in out.groupby("key"):
        ids = g["id"].to_numpy()
        for i in range(len(ids)):
            row = g.iloc[i]
            assert row["s"] == ids[max(0, i - 4) : i + 3].sum()
            assert (np.isnan(row["l"]) if i < 3 else row["l"] == ids[i - 3])
            assert (np.isnan(row["d"]) if i + 2 >= len(ids) else row["d"] == ids[i + 2])


def test_exact_quantiles(table, rows):
    out = O.exact_quantiles(table, "value", {"q25": 0.25, "q50": 0.5, "q90": 0.9}, group="key").toPandas().set_index("key")
    for key, g in rows.dropna().groupby("key"):
        np.testing.assert_allclose(out.loc[key, ["q25", "q50", "q90"]].astype(float), np.quantile(g["value"], [0.25, 0.5, 0.9]))


def test_empty_input(table):
    none = table.where("false")
    assert O.with_row_number(none, "key", "t", O.width_slice("t", 5)).count() == 0
    assert O.with_global_rank(none, ["t"]).count() == 0
    assert O.exact_quantiles(none, "value", {"q": 0.5}, group="key").count() == 0


def test_null_keys_are_one_sequence(spark):
    rows = spark.createDataFrame([(None, s) for s in (10, 20, 5000, 6000)] + [(1, 15)], "k long, s long").withColumn("ts", F.timestamp_seconds("s"))
    found = O.with_row_number(rows, "k", ["ts"], O.hour_slice("ts"), "rn").collect()
    assert sorted((r.s, r.rn) for r in found if r.k is None) == [(10, 1), (20, 2), (5000, 3), (6000, 4)]
