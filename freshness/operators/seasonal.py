"""Seasonal series: decompositions, forecasts, repairs, error models.

The array forms work on count windows, so a task handles fixed-size windows,
many at a time as one numpy matrix. The model is an iterated local regression
with an AR(1) on differences, not a copy of a statistics package; the SQL forms
(`seasonal_means`, `drift_forecast`) are exact for any engine.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F, types as T

from freshness.operators.joins import plan_slices
from freshness.operators.ordered import names, with_frames, with_row_number, with_running
from freshness.operators.windows import count_windows, uniform_draw

VECTOR = T.ArrayType(T.DoubleType())


_SMOOTHERS: dict[tuple[int, int], np.ndarray] = {}


def local_regression(size: int, span: int) -> np.ndarray:
    """Matrix that smooths a series of `size` values by tricube-weighted lines over `span` neighbours."""
    if (size, span) in _SMOOTHERS:
        return _SMOOTHERS[size, span]
    at = np.arange(size, dtype=float)
    asked, span = span, max(3, min(span, size))
    out = np.zeros((size, size))
    for i in range(size):
        distance = np.abs(at - i)
        reach = np.sort(distance)[span - 1] + 1e-9
        weight = np.clip(1 - (distance / reach) ** 3, 0, None) ** 3
        x = at - i
        s0, s1, s2 = weight.sum(), (weight * x).sum(), (weight * x * x).sum()
        det = s0 * s2 - s1 * s1
        out[i] = weight * (s2 - s1 * x) / det if det > 1e-12 else weight / s0
    _SMOOTHERS[size, asked] = out
    return out


def decompose(series: np.ndarray, period: int, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Trend and season of each row of a matrix (windows x size)."""
    count, size = series.shape
    smooth = local_regression(size, max(int(1.5 * period) | 1, 7))
    phase = np.arange(size) % period
    level = np.stack([(phase == p) / max((phase == p).sum(), 1) for p in range(period)])
    trend = series @ smooth.T
    season = np.zeros_like(series)
    for _ in range(rounds):
        profile = (series - trend) @ level.T
        profile -= profile.mean(axis=1, keepdims=True)
        season = profile[:, phase]
        trend = (series - season) @ smooth.T
    return trend, season


def forecast(series: np.ndarray, period: int, horizon: int) -> np.ndarray:
    """`horizon` values ahead of each row: AR(1) with drift on the deseasonalised differences, season added back."""
    size = series.shape[1]
    _, season = decompose(series, period)
    level = series - season
    d = np.diff(level, axis=1)
    x, y = d[:, :-1], d[:, 1:]
    mx, my = x.mean(axis=1, keepdims=True), y.mean(axis=1, keepdims=True)
    var = ((x - mx) ** 2).sum(axis=1, keepdims=True)
    phi = np.clip(((x - mx) * (y - my)).sum(axis=1, keepdims=True) / np.where(var > 1e-12, var, 1.0), -0.99, 0.99)
    drift = my - phi * mx
    ahead, last, step = [], level[:, -1:], d[:, -1:]
    for h in range(horizon):
        step = drift + phi * step
        last = last + step
        ahead.append(last[:, 0] + season[:, size - period + h % period])
    return np.stack(ahead, axis=1)


def _matrix(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), dtype=float)


def seasonal_features(windows: DataFrame, period: int, values: str = "values") -> DataFrame:
    """Each window with its last trend value and the seasonal profile of its last period."""

    def fit(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                yield pd.DataFrame({"trend": pd.Series(dtype=float), "season": pd.Series(dtype=object)})
                continue
            trend, season = decompose(_matrix(frame), period)
            yield pd.DataFrame({"trend": trend[:, -1], "season": list(season[:, -period:])})

    shape = T.StructType([T.StructField("trend", T.DoubleType()), T.StructField("season", VECTOR)])
    return windows.withColumn("_fit", F.pandas_udf(fit, shape)(values)).select("*", "_fit.*").drop("_fit")


def seasonal_forecast(windows: DataFrame, period: int, horizon: int, values: str = "values") -> DataFrame:
    """Each window with its `forecast` array for the next `horizon` steps."""

    def fit(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for frame in frames:
            yield pd.Series(list(forecast(_matrix(frame), period, horizon)) if len(frame) else [], dtype=object)

    return windows.withColumn("forecast", F.pandas_udf(fit, VECTOR)(values))


def rolling_seasonal(df, key, order, value: str, size: int, period: int, slice_by) -> DataFrame:
    """Per row with a full window: trend and seasonal profile of the last `size` values."""
    return seasonal_features(count_windows(df, key, order, value, size, 1, slice_by), period).drop("values")


def centred_trend(placed: DataFrame, key, rn: str, value: str, period: int) -> DataFrame:
    """Centred moving mean over one period (both ends half weight if it is even); null near the ends."""
    half = period // 2
    frame = lambda w: w.rowsBetween(-half, half)
    exprs = {"_sum": lambda w: F.sum(value).over(frame(w)), "_n": lambda w: F.count(value).over(frame(w))}
    if period % 2 == 0:
        exprs["_ends"] = lambda w: F.lag(value, half).over(w) + F.lead(value, half).over(w)
    framed = with_frames(placed, key, rn, half, half, exprs)
    total = F.col("_sum") - F.col("_ends") / 2 if period % 2 == 0 else F.col("_sum")
    trend = F.when(F.col("_n") == 2 * half + 1, total / period)
    return framed.withColumn("trend", trend).drop(*exprs)


def seasonal_means(df, key, order, value: str, period: int, slice_by) -> DataFrame:
    """Per key and phase: mean of value minus centred moving mean."""
    placed = with_row_number(df, key, order, slice_by, "_rn")
    detrended = centred_trend(placed, key, "_rn", value, period)
    phase = F.pmod(F.col("_rn") - 1, F.lit(period)).alias("phase")
    return detrended.groupBy(*names(key), phase).agg(F.avg(F.col(value) - F.col("trend")).alias("season"))


def oracle_decompose(df, key, order, value: str, period: int, slice_by) -> DataFrame:
    """Best case over the whole series: every row with trend, season and residual.

    Whole series can be of any length, so this is the moving-mean form.
    """
    key = names(key)
    placed = with_row_number(df, key, order, slice_by, "rn")
    rows = centred_trend(placed, key, "rn", value, period).withColumn("phase", F.pmod(F.col("rn") - 1, F.lit(period)))
    means = rows.groupBy(*key, "phase").agg(F.avg(F.col(value) - F.col("trend")).alias("season"))
    return rows.join(means, key + ["phase"]).withColumn("residual", F.col(value) - F.col("trend") - F.col("season"))


def drift_forecast(df, key, order, value: str, period: int, horizon: int, slice_by) -> DataFrame:
    """Per key and step ahead: last trend + drift x steps since it + mean of the phase."""
    key = names(key)
    rows = oracle_decompose(df, key, order, value, period, slice_by)
    known = F.when(F.col("trend").isNotNull(), F.col("rn"))
    ends = rows.groupBy(*key).agg(
        F.max("rn").alias("n"), F.min(known).alias("_a"), F.max(known).alias("_b"),
        F.min_by("trend", known).alias("_first"), F.max_by("trend", known).alias("_last"),
    )
    season = rows.select(*key, "phase", "season").distinct()
    drift = (F.col("_last") - F.col("_first")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0))
    steps = ends.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    steps = steps.withColumn("phase", F.pmod(F.col("n") + F.col("step") - 1, F.lit(period)))
    level = F.col("_last") + F.coalesce(drift, F.lit(0.0)) * (F.col("n") + F.col("step") - F.col("_b"))
    return steps.join(season, key + ["phase"]).select(*key, "n", "step", (level + F.col("season")).alias("forecast"))


def repair_anomalies(df, key, order, value: str, flag: str, size: int, period: int, slice_by) -> DataFrame:
    """Flagged points replaced by a one-step forecast of the `size` values before them.

    A repair is seen by later repairs only while it lies in their window, so
    flagged points more than `size` apart are independent: each chain of close
    ones is one group with its `size` lead-in rows, and unflagged stretches of a
    key never meet in a task. A chain is read in order and only its last `size`
    values are held. The first `size` points of a key stay as they are.
    """
    key = names(key)
    placed = with_row_number(df, key, order, slice_by, "rn")
    marks = placed.where(F.col(flag) & (F.col("rn") > size)).select(*key, "rn")
    blocks = F.floor(F.col("rn") / 65_536).cast("long")
    linked = with_running(marks, key, "rn", blocks, {"_prev": ("previous", F.col("rn"))})
    opens = F.when(F.col("_prev").isNull() | (F.col("rn") - F.col("_prev") > size), 1)
    chained = with_running(linked.withColumn("_open", opens), key, "rn", blocks, {"chain": ("count", F.col("_open"))})
    spans = chained.groupBy(*key, "chain").agg((F.min("rn") - size).alias("_from"), F.max("rn").alias("_to"))

    rows = plan_slices(spans, placed.select(*key, "rn", value, flag), key, "_from", "_to", "rn")

    def fix(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, recent = None, deque(maxlen=size)
        for frame in frames:
            done = []
            for row in frame[[*key, "chain", "rn", value, flag]].itertuples(index=False):
                *chain, rn, x, bad = row
                if chain != group:
                    group = chain
                    recent.clear()
                if bad and len(recent) == size:
                    x = float(forecast(np.array([recent]), period, 1)[0, 0])
                    done.append((*chain[:-1], rn, x))
                recent.append(x)
            yield pd.DataFrame(done, columns=[*key, "rn", "repaired"])

    types = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    shape = ", ".join(f"{c} {types[c]}" for c in key) + ", rn long, repaired double"
    in_order = rows.repartition(*key, "chain").sortWithinPartitions(*key, "chain", "rn")
    repaired = in_order.mapInPandas(fix, shape)
    return placed.join(repaired, key + ["rn"], "left").withColumn("repaired", F.coalesce("repaired", F.col(value)))


def extend_series(df, key, rn: str, trend: str, season: str, noise: str, length: int, period: int, outlier_share: float, seed: int):
    """Longer series: season and trend repeat, gaussian noise, random outliers of 70 to 100 % of the extremes.

    `df` has positions 1..n per key. Each repeat of the pattern starts from the
    trend at which the one before ended.
    """
    key = names(key)
    stats = df.groupBy(*key).agg(
        F.max(rn).alias("_n"), F.avg(noise).alias("_mean"), F.stddev(noise).alias("_std"), F.max(noise).alias("_hi"),
        F.min(noise).alias("_lo"), F.min_by(trend, rn).alias("_first"), F.max_by(trend, rn).alias("_last"),
    ).withColumn("_rep", F.floor(F.col("_n") / period) * period).where("_rep > 0")
    ends = df.select(*key, F.col(rn).alias("_rep"), (F.col(trend)).alias("_end"))
    stats = stats.join(ends, key + ["_rep"]).withColumn("_rise", F.col("_end") - F.col("_first"))
    new = stats.where(F.col("_n") < length).withColumn(
        "position", F.explode(F.sequence(F.col("_n") + 1, F.lit(length).cast("long")))
    )
    offset = F.col("position") - F.col("_n") - 1
    new = new.withColumn("_cycle", F.floor(offset / F.col("_rep"))).withColumn(rn, F.pmod(offset, F.col("_rep")) + 1)
    rows = new.join(df.select(*key, rn, F.col(trend).alias("_t"), F.col(season).alias("_s")), key + [rn])
    draw = lambda i: uniform_draw([*key, "position"], seed + i)
    gauss = F.sqrt(-2 * F.log(draw(0))) * F.cos(F.lit(6.283185307179586) * draw(1))
    size = 0.7 + 0.3 * draw(4)
    outlier = F.when(draw(2) < outlier_share, F.when(draw(3) < 0.5, F.col("_hi") * size).otherwise(F.col("_lo") * size)).otherwise(0.0)
    made = rows.select(
        *key, F.col("position").alias(rn), (F.col("_last") + F.col("_cycle") * F.col("_rise") + F.col("_t") - F.col("_first")).alias(trend),
        F.col("_s").alias(season), (F.col("_mean") + F.coalesce("_std", F.lit(0.0)) * gauss).alias(noise), outlier.alias("outlier"),
    )
    both = df.select(*key, rn, trend, season, noise, F.lit(0.0).alias("outlier")).unionByName(made)
    return both.withColumn("value", F.col(trend) + F.col(season) + F.col(noise) + F.col("outlier"))


def staleness_regression(p: DataFrame, key, staleness: str, error: str) -> DataFrame:
    """Per key the line of error on staleness."""
    return p.groupBy(*names(key)).agg(
        F.regr_slope(error, staleness).alias("slope"), F.regr_intercept(error, staleness).alias("intercept"),
        F.count(error).alias("n"),
    )


def _assembled(df: DataFrame, inputs: list[str]) -> DataFrame:
    """Rows whose inputs are all known, with their vector."""
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(df.dropna(subset=inputs))


def error_model(p: DataFrame, inputs: list[str], label: str, trees: int = 10, depth: int = 5, seed: int = 1):
    """Random forest that predicts the error from staleness, past and pending counts."""
    forest = RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    return forest.fit(_assembled(p.dropna(subset=[label]), inputs))


def predicted_error(model, df: DataFrame, inputs: list[str]) -> DataFrame:
    """`df` with the model's prediction, the score of the learned policy; null where an input is null."""
    unknown = df.where(reduce(or_, [F.col(c).isNull() for c in inputs])).withColumn("prediction", F.lit(None).cast("double"))
    return model.transform(_assembled(df, inputs)).drop("features").unionByName(unknown)


def error_regression(lags: DataFrame, inputs: list[str], label: str, test, elastic: float = 0.0, reg: float = 0.0) -> DataFrame:
    """Test MSE of a linear (elastic net) model of the future error next to the mean baseline."""
    model = LinearRegression(labelCol=label, elasticNetParam=elastic, regParam=reg).fit(_assembled(lags, inputs))
    scored = model.transform(_assembled(test, inputs))
    mean = lags.agg(F.avg(label)).scalar()
    return scored.withColumn("_mean", mean).agg(
        F.avg(F.pow(F.col("prediction") - F.col(label), 2)).alias("mse"),
        F.avg(F.pow(F.col("_mean") - F.col(label), 2)).alias("baseline_mse"), F.count(label).alias("n"),
    )


def error_forecast(err, key, order, error: str, w: int, offset: int, slice_by) -> DataFrame:
    """Future error forecast from the last w errors by AR(1), next to their mean and the actual value."""
    placed = with_row_number(err, key, order, slice_by, "_rn")
    windows = count_windows(placed, key, order, error, w, 1, slice_by, rn="_rn")

    def ahead(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for frame in frames:
            if len(frame) == 0:
                yield pd.Series([], dtype=float)
                continue
            x = _matrix(frame)
            mean = x.mean(axis=1, keepdims=True)
            a, b = x[:, :-1] - mean, x[:, 1:] - mean
            var = (a * a).sum(axis=1, keepdims=True)
            phi = np.clip((a * b).sum(axis=1, keepdims=True) / np.where(var > 1e-12, var, 1.0), -0.99, 0.99)
            yield pd.Series((mean + phi ** (offset + 1) * (x[:, -1:] - mean))[:, 0])

    scored = windows.withColumn("forecast", F.pandas_udf(ahead, T.DoubleType())("values")).withColumn(
        "baseline", F.aggregate("values", F.lit(0.0), lambda s, x: s + x) / w
    )
    actual = placed.select(*names(key), (F.col("_rn") - 1 - offset).alias("end_rn"), F.col(error).alias("actual"))
    return scored.join(actual, names(key) + ["end_rn"]).select(*names(key), "end_rn", "forecast", "baseline", "actual")
