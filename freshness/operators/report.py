"""Quality metrics and policy reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from freshness.functions.scalars import dot, forecast_at
from freshness.operators.joins import asof_left, count_before, quadratic_form, vector_moments
from freshness.operators.ordered import names, width_slice, with_frames, with_row_number, with_running
from freshness.operators.windows import tagged_union


def _miss() -> Column:
    return F.col("y_pred") - F.col("y_true")


def mse(p: DataFrame) -> DataFrame:
    """One row: mean squared error of the rows that have a prediction."""
    return p.agg(F.avg(_miss() * _miss()).alias("mse"), F.count(_miss()).alias("n"))


def _scaled(p, key, order, sp: int, slice_by, rn, size_of) -> DataFrame:
    placed, rn = (p, rn) if rn else (with_row_number(p, key, order, slice_by, "_rn"), "_rn")
    framed = with_frames(placed, key, rn, sp, 0, {"_naive": lambda w: F.col("y_true") - F.lag("y_true", sp).over(w)})
    out = framed.groupBy(*names(key)).agg(F.avg(size_of(_miss())).alias("_e"), F.avg(size_of(F.col("_naive"))).alias("_scale"))
    return out.select(*names(key), (F.col("_e") / F.nullif(F.col("_scale"), F.lit(0.0))).alias("scaled_error"))


def mase(p: DataFrame, key, order, slice_by=None, sp: int = 1, rn: str | None = None) -> DataFrame:
    """Per key: mean absolute error over the mean absolute sp-step change; null for a flat or one-row series.

    `rn` names a gapless position column when the rows already have one.
    """
    return _scaled(p, key, order, sp, slice_by, rn, F.abs)


def msse(p: DataFrame, key, order, slice_by=None, sp: int = 1, rn: str | None = None) -> DataFrame:
    """The squared form of `mase`."""
    return _scaled(p, key, order, sp, slice_by, rn, lambda x: x * x)


def total_scaled(per_key: DataFrame) -> DataFrame:
    """Scaled errors summed over keys."""
    return per_key.agg(F.sum("scaled_error").alias("total"), F.count("scaled_error").alias("n_keys"))


def freshness(served: DataFrame, version: str, staleness: str) -> DataFrame:
    """Mean staleness of served queries and how many feature versions they used."""
    used = served.where(F.col(version).isNotNull()).groupBy(version).agg(F.sum(staleness).alias("_s"), F.count(F.lit(1)).alias("_n"))
    return used.agg(
        (F.sum("_s") / F.sum("_n")).alias("mean_staleness"), F.count(F.lit(1)).alias("updates_used"), F.sum("_n").alias("n_served")
    )


def improvement_triple(queries, versions, key, ts, tie, feature: str, label: str, slice_by=None) -> DataFrame:
    """Mean squared error with the key's first feature, with the feature in force, and with its last.

    Queries before the first version use the first one. Keys without versions are left out.
    """
    key = names(key)
    order = F.struct(ts, tie)
    ends = versions.groupBy(*key).agg(F.min_by(feature, order).alias("_start"), F.max_by(feature, order).alias("_final"))
    seen = asof_left(queries, versions, key, ts, tie, [F.col(feature).alias("_now")], slice_by).join(ends, key)
    sq = lambda c: F.avg(F.pow(c - F.col(label), 2))
    return seen.agg(
        sq(F.col("_start")).alias("start_mse"), sq(F.coalesce("_now", "_start")).alias("asof_mse"),
        sq(F.col("_final")).alias("final_mse"), F.count(F.lit(1)).alias("n"),
    )


def query_audit(queries, events, versions, key, ts, tie, feature: str, label: str, slice_by=None) -> DataFrame:
    """Per query: prediction in force, best case (last version), baseline (first), label, staleness source, past, pending."""
    key = names(key)
    order = F.struct(ts, tie)
    ends = versions.groupBy(*key).agg(F.min_by(feature, order).alias("baseline"), F.max_by(feature, order).alias("oracle"))
    counted = count_before(queries, events, versions.select(*key, ts), key, ts, slice_by)
    seen = asof_left(counted, versions, key, ts, tie, [F.col(feature).alias("_now")], slice_by).join(ends, key)
    prediction = F.coalesce("_now", "baseline")
    return seen.withColumn("prediction", prediction).drop("_now").withColumn(
        "error", F.pow(F.col("oracle") - F.col("prediction"), 2)
    )


def feature_loss(vectors: DataFrame, items: DataFrame, feature: str, oracle: str, item_vec: str, size: int) -> DataFrame:
    """Distance of each feature to the best-case feature, and mean squared difference of their scores on all items.

    The second is (f - o)' (sum m m') (f - o) / n, from one small row of item sums.
    """
    moments = vector_moments(items, item_vec, size).select(F.struct("n", "gram")).scalar()
    gap = F.zip_with(feature, oracle, lambda a, b: a - b)
    rows = vectors.withColumn("_m", moments).withColumn("_gap", gap)
    return rows.select(
        *[c for c in vectors.columns if c not in (feature, oracle)],
        F.sqrt(dot("_gap", "_gap")).alias("distance"),
        (quadratic_form(F.col("_gap"), F.col("_m.gram")) / F.col("_m.n")).alias("prediction_mse"),
    )


def policy_results(predictions: DataFrame, updates: DataFrame, params) -> DataFrame:
    """Per parameter set: error, total updates and last update time."""
    params = names(params)
    error = predictions.groupBy(*params).agg(F.avg(_miss() * _miss()).alias("mse"), F.count(_miss()).alias("n"))
    spent = updates.groupBy(*params).agg(F.count(F.lit(1)).alias("total_updates"), F.max("time").alias("last_time"))
    return error.join(spent, params, "left").fillna(0, ["total_updates"])


def bounds(results: DataFrame, policy: str, error: str, no_update: str, all_update: str) -> DataFrame:
    """Each policy's error with both bounds and its distance to the best possible."""
    pick = lambda name: F.max(F.when(F.col(policy) == name, F.col(error)))
    ends = results.agg(F.struct(pick(all_update).alias("lower"), pick(no_update).alias("upper"))).scalar()
    rows = results.withColumn("_b", ends).select("*", F.col("_b.lower").alias("lower_bound"), F.col("_b.upper").alias("upper_bound")).drop("_b")
    return rows.withColumn("above_bound", F.col(error) - F.col("lower_bound"))


def best_baseline(err: DataFrame, by, policy: str, error: str, chosen: str) -> DataFrame:
    """Least error among the other policies minus the chosen one's, per group."""
    own = F.max(F.when(F.col(policy) == chosen, F.col(error)))
    other = F.min(F.when(F.col(policy) != chosen, F.col(error)))
    return err.groupBy(*names(by)).agg(other.alias("best_other"), own.alias("chosen")).withColumn(
        "gain", F.col("best_other") - F.col("chosen")
    )


def improvement_by_segment(p: DataFrame, segments: dict[str, Column], policy: str, base: str, better: str) -> DataFrame:
    """Mean squared error of two policies and their difference on each segment (a boolean column)."""
    tags = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in segments.items()]))
    long = p.withColumn("segment", F.explode(tags))
    sq = _miss() * _miss()
    rows = long.groupBy("segment").agg(
        F.avg(F.when(F.col(policy) == base, sq)).alias("base_mse"), F.avg(F.when(F.col(policy) == better, sq)).alias("policy_mse")
    )
    return rows.withColumn("improvement", F.col("base_mse") - F.col("policy_mse"))


def user_wins(p: DataFrame, key, policy: str, ours: str, other: str, ratio: float = 0.9) -> DataFrame:
    """Keys whose summed absolute error under `ours` is below `ratio` x that of the other policy."""
    total = lambda name: F.sum(F.when(F.col(policy) == name, F.abs(_miss())))
    sums = p.groupBy(*names(key)).agg(total(ours).alias("ours"), total(other).alias("other"))
    return sums.where(F.col("ours") < F.col("other") * F.lit(ratio))


def update_share(updates: DataFrame, points: DataFrame, key) -> DataFrame:
    """Updates per data point of each key and policy."""
    key = names(key)
    n_updates = updates.groupBy(*key, "policy").agg(F.count(F.lit(1)).alias("n_updates"))
    n_points = points.groupBy(*key).agg(F.count(F.lit(1)).alias("n_points"))
    return n_updates.join(n_points, key).withColumn("share", F.col("n_updates") / F.col("n_points"))


def improvement_vs_rate(gains: DataFrame, rates: DataFrame, step: str, rate: str, gain: str) -> DataFrame:
    """Mean gain per arrival rate."""
    return gains.join(rates.select(step, rate), step).groupBy(rate).agg(F.avg(gain).alias("mean_gain"), F.count(gain).alias("n"))


def error_growth(points, models, key, t: str, value: str, horizon: int) -> DataFrame:
    """Summed scaled error of a stored forecast by its age 1..horizon.

    `models` (key, model_t, forecast, scale) hold one forecast per key, with the
    scale taken from its own fit.
    """
    key = names(key)
    age = (F.col(t) - F.col("model_t")).alias("age")
    miss = F.abs(F.col(value) - forecast_at("forecast", F.col(t), F.col("model_t") + 1)) / F.nullif(F.col("scale"), F.lit(0.0))
    rows = points.join(models, key).where((F.col(t) > F.col("model_t")) & (F.col(t) <= F.col("model_t") + horizon))
    aged = rows.select(*key, age, miss.alias("_e"))
    return with_running(aged, key, "age", width_slice("age", 65_536), {"total_error": ("sum", F.col("_e"))}).drop("_e")


def error_by_workers(parts: list[tuple[DataFrame, int]], ts: str, warmup) -> DataFrame:
    """Per worker count: error in force, start error and mean distance of the two, on all rows and after a warm-up.

    Each part has (y_true, y_pred, y_start, ts).
    """
    stacked = tagged_union([(df, {"workers": n}) for df, n in parts])
    late = F.col(ts) > warmup
    sq = lambda a, b: F.pow(F.col(a) - F.col(b), 2)
    aggs = []
    for name, cond in (("all", F.lit(True)), ("late", late)):
        aggs += [
            F.avg(F.when(cond, sq("y_pred", "y_true"))).alias(f"mse_{name}"),
            F.avg(F.when(cond, sq("y_start", "y_true"))).alias(f"start_mse_{name}"),
            F.avg(F.when(cond, sq("y_pred", "y_start"))).alias(f"distance_{name}"),
        ]
    return stacked.groupBy("workers").agg(*aggs)


def slide_error(points, key, rn: str, value: str, start: int, slides: list[int], tie: str, slice_by) -> DataFrame:
    """Scaled error of static plans: the model of every `slide`-th point (from `start`) serves until the next.

    The stored model is the last value plus the mean step so far.
    """
    key = names(key)
    first = with_running(
        points, key, rn, slice_by, {"_first": ("first", F.col(value))}
    ).withColumn("slide", F.explode(F.array(*[F.lit(s) for s in slides])))
    drift = (F.col(value) - F.col("_first")) / F.nullif(F.col(rn) - 1, F.lit(0))
    models = first.where((F.col(rn) >= start) & ((F.col(rn) - start) % F.col("slide") == 0)).select(
        *key, "slide", rn, tie, F.col(value).alias("_base"), drift.alias("_drift")
    )
    asked = first.select(*key, "slide", rn, F.col(value).alias("y_true"))
    served = asof_left(asked, models, key + ["slide"], rn, tie, ["_base", "_drift"], slice_by).where("_base IS NOT NULL")
    p = served.withColumn("y_pred", F.col("_base") + F.col("_drift") * (F.col(rn) - F.col("feature_ts")))
    return mase(p, key + ["slide"], rn, rn=rn)


def workload_table(parts: dict[str, DataFrame]) -> DataFrame:
    """One result table over all workloads; each part has (policy, error)."""
    return tagged_union([(df.select("policy", "error"), {"workload": name}) for name, df in parts.items()])
