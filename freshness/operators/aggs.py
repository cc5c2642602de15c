"""Aggregates over events, errors, updates and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from freshness.functions.scalars import weighted_avg
from freshness.operators.ordered import columns, exact_quantiles, names, with_row_number


def busy_keys(df: DataFrame, key, n: int) -> DataFrame:
    """Keys with more than n rows, with the count."""
    return df.groupBy(*names(key)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > n)


def past_updates(df: DataFrame, key) -> DataFrame:
    """Rows per key."""
    return df.groupBy(*names(key)).agg(F.count(F.lit(1)).alias("past_updates"))


def arrival_rate(df: DataFrame, step: str, key: str, approximate: bool = False) -> DataFrame:
    """Distinct keys and rows per step."""
    if approximate:
        return df.groupBy(step).agg(F.approx_count_distinct(key).alias("keys"), F.count(F.lit(1)).alias("n"))
    pairs = df.groupBy(step, key).agg(F.count(F.lit(1)).alias("_n"))
    return pairs.groupBy(step).agg(F.count(key).alias("keys"), F.sum("_n").alias("n"))


def key_span(df: DataFrame, key, ts: str) -> DataFrame:
    """First and last time of each key and the seconds between."""
    span = df.groupBy(*names(key)).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    seconds = (F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))) / 1e6
    return span.withColumn("length", seconds)


def rating_pivot(df: DataFrame, user: str, item: str, rating: str, items: list) -> DataFrame:
    """User rows, one column per listed item with its mean rating, 0 where absent.

    For a bounded item list; beyond that keep the long form, where absence is the 0.
    """
    wide = df.groupBy(user).pivot(item, items).agg(F.avg(rating))
    return wide.fillna(0.0)


def update_heatmap(updates: DataFrame, key: str, policies: list[str]) -> DataFrame:
    """Updates per key, one column per policy, 0 where none."""
    return updates.groupBy(key).pivot("policy", policies).agg(F.count(F.lit(1))).fillna(0)


def update_counts(updates: DataFrame, cols) -> DataFrame:
    """Updates per combination of the given columns."""
    return updates.groupBy(*columns(cols)).agg(F.count(F.lit(1)).alias("n_updates"))


def throughput_summary(log: DataFrame, workers: int) -> DataFrame:
    """One row: ingest span, total time, rates, mean runtime and the expected total runtime."""
    m = log.agg(
        F.count(F.lit(1)).alias("n_updates"),
        (F.max("ingest_time") - F.min("ingest_time")).alias("ingest_span"),
        (F.max("processing_time") - F.min("ingest_time")).alias("total_time"),
        F.avg("runtime").alias("mean_runtime"),
    )
    return m.select(
        "*",
        (F.col("n_updates") / F.col("total_time")).alias("rate"),
        (F.col("mean_runtime") * F.col("n_updates") / F.lit(workers)).alias("expected_runtime"),
    )


def latency(log: DataFrame, slice_by=None) -> DataFrame:
    """Minimum, median and mean of processing minus ingest time."""
    waits = log.select((F.col("processing_time") - F.col("ingest_time")).alias("wait"))
    simple = waits.agg(F.min("wait").alias("min_latency"), F.avg("wait").alias("mean_latency"))
    return simple.withColumn("median_latency", exact_quantiles(waits, "wait", {"m": 0.5}, slice_by=slice_by).scalar())


def error_by_group(p: DataFrame, cols) -> DataFrame:
    """Mean squared and mean absolute error per group."""
    d = F.col("y_pred") - F.col("y_true")
    return p.groupBy(*names(cols)).agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.count(d).alias("n"))


def error_vs_factor(p: DataFrame, factor: str, error: str, slice_by=None) -> DataFrame:
    """Mean and exact median error per factor value, with the log of both."""
    mean = p.groupBy(factor).agg(F.avg(error).alias("mean_error"), F.count(error).alias("n"))
    median = exact_quantiles(p, error, {"median_error": 0.5}, group=factor, slice_by=slice_by)
    return mean.join(median, factor).select(
        "*", F.log("mean_error").alias("log_mean"), F.log(F.nullif("median_error", F.lit(0.0))).alias("log_median")
    )


def hourly_error(p: DataFrame, step: str, width: int, cols) -> DataFrame:
    """Summed absolute error per bucket of `width` steps and group."""
    bucket = F.floor(F.col(step) / width).cast("long").alias("bucket")
    return p.groupBy(bucket, *names(cols)).agg(F.sum(F.abs(F.col("y_pred") - F.col("y_true"))).alias("abs_error"))


def cross_key_mse(p: DataFrame, step: str) -> DataFrame:
    """Per step: summed squared error over the number of non-zero errors."""
    sq = F.pow(F.col("y_pred") - F.col("y_true"), 2)
    return p.groupBy(step).agg((F.sum(sq) / F.nullif(F.count_if(sq != 0), F.lit(0))).alias("mse"))


def loss_describe(df: DataFrame, by: str, loss: str, slice_by=None) -> DataFrame:
    """Count, mean, deviation and exact quartiles of the loss per group."""
    basic = df.groupBy(by).agg(
        F.count(loss).alias("n"), F.avg(loss).alias("mean"), F.stddev(loss).alias("std"),
        F.min(loss).alias("min"), F.max(loss).alias("max"),
    )
    quartiles = exact_quantiles(df, loss, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, group=by, slice_by=slice_by)
    return basic.join(quartiles, by)


def distinct_versions(p: DataFrame, key, version: str) -> DataFrame:
    """Number of different feature versions each key used; nulls do not count."""
    pairs = p.select(*names(key), version).distinct()
    return pairs.groupBy(*names(key)).agg(F.count(version).alias("n_versions"))


def collect_chunks(df: DataFrame, group, order, values: dict[str, Column], slice_by, max_list: int = 10_000) -> DataFrame:
    """Ordered lists of the group's rows, at most `max_list` rows per list.

    Long groups give several lists, numbered by `chunk`, so no row of the result
    and no task grows with the group.
    """
    group = names(group)
    placed = with_row_number(df, group, order, slice_by, "_rn")
    chunk = F.floor((F.col("_rn") - 1) / max_list).cast("long")
    packed = F.struct("_rn", *[v.alias(n) for n, v in values.items()])
    lists = placed.groupBy(*group, chunk.alias("chunk")).agg(F.sort_array(F.collect_list(packed)).alias("_l"))
    return lists.select(*group, "chunk", *[F.col("_l")[n].alias(n) for n in values])


def fold_step_events(df: DataFrame, user: str, ts: str, item: str, rating: str, order, slice_by, max_list=10_000):
    """Items and ratings of one user in one step as lists, in order."""
    return collect_chunks(df, [user, ts], order, {"items": F.col(item), "ratings": F.col(rating)}, slice_by, max_list)


def minute_streams(edits: DataFrame, doc: str, minute: str, edit_id: str, slice_by, max_list=10_000) -> DataFrame:
    """Edit ids of each document and minute as lists."""
    return collect_chunks(edits, [minute, doc], edit_id, {"edits": F.col(edit_id)}, slice_by, max_list)


def first_edits(edits: DataFrame, doc: str, order, edit_id: str) -> DataFrame:
    """The edit each document starts from."""
    return edits.groupBy(doc).agg(F.min_by(edit_id, F.struct(*columns(order))).alias("init_edit"))


def weighted_mean_by(df: DataFrame, by, value: str, weight: str) -> DataFrame:
    """Weighted mean per group."""
    return df.groupBy(*names(by)).agg(weighted_avg(value, weight).alias("weighted_avg"))


def view_shares(views: DataFrame, key, count: str) -> DataFrame:
    """Each key's views as a share of all views."""
    total = views.agg(F.sum(count)).scalar()
    per_key = views.groupBy(*names(key)).agg(F.sum(count).alias("n_views"))
    return per_key.withColumn("share", F.col("n_views") / total)


def views_long(wide: DataFrame, ids, days: list[str], epoch_day: str) -> DataFrame:
    """Day columns (yyyymmdd00) to rows, with the minute index of the day's start."""
    long = wide.unpivot(names(ids), days, "day", "n_views")
    date = F.to_date(F.substring("day", 1, 8), "yyyyMMdd")
    return long.select(
        *names(ids), date.alias("day"), "n_views",
        (F.datediff(date, F.lit(epoch_day).cast("date")).cast("long") * 1440).alias("ts_min"),
    )


def weight_bucket(weight: str | Column, buckets: list[int]) -> Column:
    """weight // 10 (at least 1) rounded up to the next bucket; above all buckets, the last."""
    weight = F.col(weight) if isinstance(weight, str) else weight
    w = F.greatest(F.floor(weight / 10).cast("long"), F.lit(1))
    chain = F
    for b in buckets:
        chain = chain.when(w <= b, b)
    return chain.otherwise(buckets[-1]).cast("long")


def edit_query_counts(edits: DataFrame, queries: DataFrame, doc: str) -> DataFrame:
    """Edits and queries per document."""
    both = edits.select(doc, F.lit(1).alias("e"), F.lit(0).alias("q")).unionByName(
        queries.select(doc, F.lit(0).alias("e"), F.lit(1).alias("q"))
    )
    return both.groupBy(doc).agg(F.sum("e").alias("n_edits"), F.sum("q").alias("n_queries"))


def coverage_report(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Long report: keys per time, times per key, and keys starting at each time."""
    per_pair = df.select(key, ts).distinct()
    keys_per_time = per_pair.groupBy(ts).agg(F.count(key).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("times"))
    per_key = per_pair.groupBy(key).agg(F.count(ts).alias("n"), F.min(ts).alias("first_ts"))
    times_per_key = per_key.groupBy("n").agg(F.count(F.lit(1)).alias("times"))
    firsts = per_key.groupBy(F.col("first_ts").cast("long").alias("n")).agg(F.count(F.lit(1)).alias("times"))
    parts = [("keys_per_time", keys_per_time), ("times_per_key", times_per_key), ("first_times", firsts)]
    out = None
    for name, part in parts:
        part = part.select(F.lit(name).alias("report"), F.col("n").cast("long").alias("bin"), "times")
        out = part if out is None else out.unionByName(part)
    return out


def new_key_stats(train: DataFrame, stream: DataFrame, key: str) -> DataFrame:
    """Keys of the stream that training never saw, and their mean row count."""
    fresh = stream.join(train.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return fresh.agg(F.count(key).alias("n_new_keys"), F.avg("_n").alias("mean_rows"))
