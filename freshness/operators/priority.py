"""Which keys to refresh next: inputs, scores, ranks, budgets, plans.

A policy is a score column over the table of `priority_inputs`; `rank_keys`
turns it into a ranked key table (highest score first, lowest key on ties).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from freshness.operators.ordered import hour_slice, names, range_slices, with_global_rank, with_row_number, with_running
from freshness.operators.windows import uniform_draw

COLD_ERROR = 1e6  # score of keys never trained, total-error and forecast-error policies
COLD_QUERIES = 1e8  # score of keys never refreshed, query-proportional policy


def priority_inputs(events, updates, predictions, key: str, ts: str, slice_by=None, decimals: int = 6) -> DataFrame:
    """Per key: pending events, error and queries since the last update, times, past updates.

    `predictions` has (key, ts, error) with error >= 0. The last update of a key
    reaches its rows slice by slice, so a hot key is never one group, and the
    sums are pre-aggregated.
    """
    slice_by = hour_slice(ts) if slice_by is None else slice_by
    rows = (
        events.select(key, ts, F.lit("event").alias("_kind"))
        .unionByName(updates.select(key, ts, F.lit("update").alias("_kind")))
        .unionByName(predictions.select(key, ts, F.lit("query").alias("_kind"), F.col("error").alias("_error")), True)
    )
    is_update = F.col("_kind") == "update"
    marked = with_running(rows, key, ts, slice_by, totals={"last_update": ("max", F.when(is_update, F.col(ts)))})
    open_row = F.col("last_update").isNull() | (F.col(ts) > F.col("last_update"))
    is_event, is_query = F.col("_kind") == "event", F.col("_kind") == "query"
    return marked.groupBy(key).agg(
        F.count_if(is_event & open_row).alias("pending"),
        F.round(F.coalesce(F.sum(F.when(is_query & open_row, F.abs("_error"))), F.lit(0.0)), decimals).alias("error_since"),
        F.count_if(is_query & open_row).alias("queries_since"),
        F.max(F.when(is_event, F.col(ts))).alias("last_event"),
        F.max(F.when(is_query, F.col(ts))).alias("last_query"),
        F.max("last_update").alias("last_update"),
        F.count_if(is_update).alias("past_updates"),
    )


def rank_keys(inputs: DataFrame, key: str, score: Column, pending_only: bool = True) -> DataFrame:
    """(key, score, rank) with rank 1 for the highest score; keys without waiting events are left out."""
    keys = inputs.where(F.col("pending") > 0) if pending_only else inputs
    scored = keys.select(key, score.alias("score")).where(F.col("score").isNotNull())
    return with_global_rank(scored, [F.col("score").desc(), F.col(key)], "rank")


def total_error() -> Column:
    """Summed absolute error since the last update."""
    return F.col("error_since")


def total_error_cold() -> Column:
    """As `total_error`; keys without any update come first."""
    return F.when(F.col("past_updates") == 0, F.lit(COLD_ERROR)).otherwise(F.col("error_since"))


def last_query() -> Column:
    """Most recently touched key."""
    return F.unix_micros(F.col("last_query").cast("timestamp"))


def max_pending() -> Column:
    """Most waiting events."""
    return F.col("pending")


def min_past() -> Column:
    """Fewest past updates."""
    return F.lit(1.0) / (F.col("past_updates") + 1)


def round_robin(now: Column) -> Column:
    """Longest since the last update; keys never updated come first."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.coalesce(micros(now) - micros(F.col("last_update")), F.lit(2**62))


def query_proportional() -> Column:
    """Most queries since the last update."""
    return F.col("queries_since")


def query_proportional_cold() -> Column:
    """As `query_proportional`; keys never refreshed come first."""
    return F.when(F.col("past_updates") == 0, F.lit(COLD_QUERIES)).otherwise(F.col("queries_since").cast("double"))


def random_score(key: str, seed: int, round_no: int = 0) -> Column:
    """Uniform over keys, new in every round, repeatable."""
    return uniform_draw([F.col(key), F.lit(round_no)], seed)


def max_staleness(now: Column, made: str = "last_update") -> Column:
    """Age of the key's model in seconds."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(now) - micros(F.col(made))) / 1e6


def forecast_errors(points, models, predicted: Column, key, order, t: str, value: str, slice_by, decimals: int = 6) -> DataFrame:
    """Per key: total scaled error of the stored forecast on points newer than the model.

    `points` (key, t, value) are the readings, `models` (key, model_t, ...) hold one model per key, and
    `predicted` is its forecast for a reading, over the columns of both and defined at any age. The scale is
    the mean absolute one-step change of the readings up to the model; without a change there the error is null.
    All readings of a key without a model are waiting, and its error is `COLD_ERROR`.
    """
    stepped = with_running(points, key, order, slice_by, {"_prev": ("previous", F.struct(F.col(value).alias("v")))})
    joined = stepped.join(models, names(key), "left")
    cold = F.col("model_t").isNull()
    newer = cold | (F.col(t) > F.col("model_t"))
    miss = F.abs(F.col(value) - predicted)
    naive = F.abs(F.col(value) - F.col("_prev.v"))
    per_key = joined.groupBy(*names(key)).agg(
        F.sum(F.when(newer, miss)).alias("_miss"),
        F.avg(F.when(~newer, naive)).alias("_scale"),
        F.count_if(newer).alias("pending"),
        F.bool_or(cold).alias("_cold"),
    )
    scaled = F.round(F.col("_miss") / F.nullif(F.col("_scale"), F.lit(0.0)), decimals)
    return per_key.select(*names(key), "pending", F.when(F.col("_cold"), F.lit(COLD_ERROR)).otherwise(scaled).alias("error"))


def forecast_error_score(previous: Column | None = None, epsilon: float | None = None) -> Column:
    """Total scaled error; with epsilon the score also grows by epsilon each round."""
    if epsilon is None:
        return F.col("error")
    return F.greatest(F.coalesce(previous, F.lit(0.0)) + F.lit(epsilon), F.col("error"))


def weighted_pending(weight: str = "weight") -> Column:
    """View weight x waiting events."""
    return F.col(weight) * F.col("pending")


def weighted_draw(key: str, seed: int, weight: str = "weight") -> Column:
    """Random order in which a key's chance to come first is proportional to its weight."""
    return F.log(uniform_draw([key], seed)) / F.col(weight)


def take_budget(ranked: DataFrame, budget: int) -> DataFrame:
    """The keys one round can refresh."""
    return ranked.where(F.col("rank") <= budget)


def take_budget_rounds(scored: DataFrame, key: str, round_col: str, budget: float) -> DataFrame:
    """Per round the best keys that the budget allows; fractions carry over to the next round.

    `scored` has (round from 1, key, score). Round r may take
    floor(r x budget) - floor((r - 1) x budget) keys.
    """
    order = [F.col(round_col), F.col("score").desc(), F.col(key)]
    sliced = range_slices(scored, order)
    ranked = with_row_number(sliced, round_col, order, "_slice", "rank")
    allowed = F.floor(F.col(round_col) * F.lit(budget)) - F.floor((F.col(round_col) - 1) * F.lit(budget))
    return ranked.where(F.col("rank") <= allowed)


def batch_when_affordable(arrivals: DataFrame, round_col: str, count: str, budget: float, slice_by) -> DataFrame:
    """Rounds in which everything waiting is refreshed, and how many events each refresh covers.

    Unspent budget is kept, so a round can pay for all waiting events exactly
    when the budget so far covers all events so far.
    """
    summed = with_running(arrivals, None, round_col, slice_by, {"_seen": ("sum", F.col(count))})
    paid = summed.where(F.col(round_col) * F.lit(budget) >= F.col("_seen"))
    fired = with_running(paid, None, round_col, slice_by, {"_before": ("previous", F.col("_seen"))})
    return fired.select(round_col, (F.col("_seen") - F.coalesce("_before", F.lit(0))).alias("refreshed"))


def shed_oldest(df, key, order, size: int, slice_by) -> DataFrame:
    """Keys with more than `size` waiting rows keep only the newest size // 2."""
    placed = with_running(df, key, order, slice_by, {"_rn": ("count", F.lit(1))}, {"_n": ("count", F.lit(1))})
    newest = F.col("_n") - F.col("_rn") < size // 2
    return placed.where((F.col("_n") <= size) | newest).drop("_rn", "_n")


def shed_sample(df: DataFrame, row_id: str, frac: float) -> DataFrame:
    """A fraction of the events, chosen by id arithmetic."""
    return df.where(F.pmod(F.col(row_id) * 7919, F.lit(1000)) < 1000 * frac)


def static_plan(keys: DataFrame, start: int, length: str, slide: str) -> DataFrame:
    """Update times of each key: every `slide` steps from `start` up to its length."""
    times = F.sequence(F.lit(start).cast("long"), F.col(length), F.col(slide))
    return keys.where(F.col(length) >= start).withColumn("time", F.explode(times))


def static_plan_of_fits(keys: DataFrame, start: int, length: str, fits: str) -> DataFrame:
    """`fits` evenly spaced update times per key."""
    at = F.transform(F.sequence(F.lit(0).cast("long"), F.col(fits) - 1), lambda i: F.lit(start) + F.floor((F.col(length) - start) * i / F.col(fits)))
    return keys.where(F.col(fits) >= 1).withColumn("time", F.explode(at))


def allocate_fits(loss: DataFrame, key: str, fits: str, loss_col: str, max_fits: int, decimals: int = 9) -> DataFrame:
    """Fits per key with least total loss under a cap on all fits.

    Extra fits are taken in order of the loss they save; exact when the saving of
    a key falls with each extra fit.
    """
    before = loss.select(key, (F.col(fits) + 1).alias(fits), F.col(loss_col).alias("_before"))
    gains = loss.join(before, [key, fits]).select(key, fits, F.round(F.col("_before") - F.col(loss_col), decimals).alias("_gain"))
    useful = gains.where("_gain > 0")
    ranked = with_global_rank(useful, [F.col("_gain").desc(), F.col(key), F.col(fits)], "_rank")
    taken = ranked.where(F.col("_rank") <= max_fits).groupBy(key).agg(F.count(F.lit(1)).alias("extra_fits"))
    least = loss.groupBy(key).agg(F.min(fits).alias("_least"))
    return least.join(taken, key, "left").select(key, (F.col("_least") + F.coalesce("extra_fits", F.lit(0))).alias("n_fits"))


def slide_for_fits(length: str, fits: str) -> Column:
    """Slide size that gives about `fits` fits over `length` steps."""
    return F.round(F.col(length) / F.col(fits)).cast("long")
