"""Joins of queries, feature versions, plans, documents and clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from freshness.functions.scalars import dot, forecast_at, residual, steps_between
from freshness.operators.ordered import hour_slice, names, with_running
from freshness.session import stage


def _asof(queries, features, key, ts, tie, payload, strict, slice_by, default=None):
    key = names(key)
    q_side, f_side = (0, 1) if strict else (1, 0)
    tie_type = features.schema[tie].dataType
    feature = F.struct(F.col(ts).alias("feature_ts"), *payload)
    asked = queries.select(
        *key, ts, F.lit(q_side).alias("_side"), F.lit(None).cast(tie_type).alias("_tie"),
        F.struct(*queries.columns).alias("_q"),
    )
    known = features.select(
        *key, ts, F.lit(f_side).alias("_side"), F.col(tie).alias("_tie"), feature.alias("_f")
    )
    if default is not None:
        blank = F.lit(None).cast(features.schema[ts].dataType)
        initial = default.select(
            *key, blank.alias(ts), F.lit(f_side).alias("_side"), F.lit(None).cast(tie_type).alias("_tie"),
            F.struct(blank.alias("feature_ts"), *payload).alias("_f"),
        )
        known = known.unionByName(initial)
    known = known.dropna(subset=key)  # a version without a key is nobody's; a query without one stays unmatched
    both = asked.unionByName(known, allowMissingColumns=True)
    slice_by = hour_slice(ts) if slice_by is None else slice_by
    seen = with_running(both, key, [ts, "_side", "_tie"], slice_by, {"_seen": ("last", F.col("_f"))})
    return seen.where(F.col("_q").isNotNull()).select("_q.*", "_seen.*")


def asof_left(queries, features, key, ts, tie, payload, slice_by=None) -> DataFrame:
    """Each query with the last feature version at or before it; nulls when there is none.

    Versions with equal time are ordered by `tie`. `slice_by` splits the order
    of one key over tasks (default: by hour of a timestamp).
    """
    return _asof(queries, features, key, ts, tie, payload, False, slice_by)


def asof_inner(queries, features, key, ts, tie, payload, slice_by=None) -> DataFrame:
    """As `asof_left`, without the queries that have no version."""
    return asof_left(queries, features, key, ts, tie, payload, slice_by).where("feature_ts IS NOT NULL")


def asof_strict(queries, features, key, ts, tie, payload, slice_by=None) -> DataFrame:
    """As `asof_left`, with versions strictly before the query only."""
    return _asof(queries, features, key, ts, tie, payload, True, slice_by)


def asof_with_default(queries, features, default, key, ts, tie, payload, slice_by=None) -> DataFrame:
    """As `asof_left`, falling back to the key's row of `default` (feature time null)."""
    return _asof(queries, features, key, ts, tie, payload, False, slice_by, default)


def attach_clock(df: DataFrame, clock: DataFrame, step: str) -> DataFrame:
    """Add the wall time of each event step."""
    return df.join(clock, step)


def join_oracle(queries: DataFrame, oracle: DataFrame, on) -> DataFrame:
    """Queries with the best-case feature of the same time, key and value."""
    return queries.join(oracle, names(on))


def join_predictions(queries: DataFrame, predictions: DataFrame, on, suffixes=("_x", "_y")) -> DataFrame:
    """Equi join whose shared other columns carry a side suffix."""
    on = names(on)
    shared = (set(queries.columns) & set(predictions.columns)) - set(on)
    left = queries.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = predictions.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return left.join(right, on)


def only_known_items(stream: DataFrame, train: DataFrame, item: str) -> DataFrame:
    """Stream rows whose item occurs in the training rows."""
    return stream.join(train.select(item).distinct(), item, "left_semi")


def enrich_left(ratings: DataFrame, titles: DataFrame, tags: DataFrame, title_key: str, tag_key) -> DataFrame:
    """Ratings with title and tag, null where unknown."""
    return ratings.join(titles, title_key, "left").join(tags, names(tag_key), "left")


def time_spine(counts: DataFrame, step: str, values) -> DataFrame:
    """Every step between the first and the last, with 0 for missing values."""
    ends = counts.agg(F.min(step).alias("a"), F.max(step).alias("b"))
    spine = ends.where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias(step))
    return spine.join(counts, step, "left").fillna(0, names(values))


def count_before(queries, events, updates, key, ts, slice_by=None) -> DataFrame:
    """Per query: events already in the feature (`past`) and still waiting (`pending`).

    An event counts as processed when it is not later than the key's last update
    at or before the query; updates see events of their own time.
    """
    key = names(key)
    slice_by = hour_slice(ts) if slice_by is None else slice_by
    rows = (
        events.select(*key, ts, F.lit(0).alias("_side"))
        .unionByName(updates.select(*key, ts, F.lit(1).alias("_side")))
        .unionByName(
            queries.select(*key, ts, F.lit(2).alias("_side"), F.struct(*queries.columns).alias("_q")),
            allowMissingColumns=True,
        )
    )
    is_event = F.when(F.col("_side") == 0, 1)
    # Read twice by the next pass: one write is cheaper than a second wide shuffle.
    counted = stage(with_running(rows, key, [ts, "_side"], slice_by, {"_n": ("count", is_event)}))
    at_update = F.when(F.col("_side") == 1, F.col("_n"))
    done = with_running(counted, key, [ts, "_side"], slice_by, {"_done": ("max", at_update)})
    past = F.coalesce("_done", F.lit(0))
    return done.where("_q IS NOT NULL").select("_q.*", past.alias("past"), (F.col("_n") - past).alias("pending"))


def plan_slices(plan: DataFrame, rows: DataFrame, key, start: str, end: str, index: str, block: int = 1024) -> DataFrame:
    """Rows whose index lies in [start, end] of a planned fit of the same key.

    The range condition becomes an equi join on blocks of `block` positions, so
    a key with many rows and many plans is never compared all against all.
    """
    key = names(key)
    blocks = F.sequence(F.floor(F.col(start) / block), F.floor(F.col(end) / block))
    spread = plan.where(F.col(start) <= F.col(end)).withColumn("_block", F.explode(blocks))
    placed = rows.withColumn("_block", F.floor(F.col(index) / block))
    return spread.join(placed, key + ["_block"]).where(F.col(index).between(F.col(start), F.col(end))).drop("_block")


def revision_pairs(changes: DataFrame, docs: DataFrame) -> DataFrame:
    """Old and new text of each change; both revisions must be known."""
    new = docs.select(F.col("revid"), F.col("text").alias("new_text"))
    old = docs.select(F.col("revid").alias("old_revid"), F.col("text").alias("old_text"))
    return changes.join(new, "revid").join(old, "old_revid")


def title_ids(views: DataFrame, edits: DataFrame, title: str, page_id: str) -> DataFrame:
    """Page id of each viewed title, from the edits that name both."""
    return views.join(edits.select(title, page_id).distinct(), title)


def policy_vs_reference(errors: DataFrame, reference: str, step: str, policy: str = "policy", error: str = "error"):
    """Every policy's error next to the reference policy's error of the same step."""
    base = errors.where(F.col(policy) == reference).select(step, F.col(error).alias("reference_error"))
    return errors.join(base, step, "left").withColumn("difference", F.col(error) - F.col("reference_error"))


def vector_moments(items: DataFrame, vector: str, size: int) -> DataFrame:
    """One row: count, sum vector and upper Gram entries of all vectors, pre-aggregated."""
    v = F.col(vector)
    sums = [F.sum(F.get(v, F.lit(i))).alias(f"s{i}") for i in range(size)]
    gram = [
        F.sum(F.get(v, F.lit(i)) * F.get(v, F.lit(j))).alias(f"g{i}_{j}") for i in range(size) for j in range(i, size)
    ]
    return items.agg(
        F.count(F.lit(1)).alias("n"), *sums, *gram
    ).select(
        "n",
        F.array(*[f"s{i}" for i in range(size)]).alias("total"),
        F.array(*[F.array(*[f"g{min(i, j)}_{max(i, j)}" for j in range(size)]) for i in range(size)]).alias("gram"),
    )


def quadratic_form(vector: Column, gram: Column) -> Column:
    """v' G v with G an array of rows."""
    return dot(vector, F.transform(gram, lambda row: dot(row, vector)))


def score_all_items(users: DataFrame, items: DataFrame, user_vec: str, item_vec: str, size: int) -> DataFrame:
    """Mean and mean square of a user's scores over all items.

    sum(u.m) = u.sum(m) and sum((u.m)^2) = u' (sum m m') u, so the items are
    reduced to one small row first and no user meets every item.
    """
    moments = vector_moments(items, item_vec, size)
    packed = moments.select(F.struct("n", "total", "gram")).scalar()
    u, m = F.col(user_vec), F.col("_m")
    return users.withColumn("_m", packed).select(
        *[c for c in users.columns if c != user_vec],
        m["n"].alias("n_items"),
        (dot(u, m["total"]) / m["n"]).alias("mean_score"),
        (quadratic_form(u, m["gram"]) / m["n"]).alias("mean_sq_score"),
    )


def version_table(init: DataFrame, plan: DataFrame, revisions: DataFrame) -> DataFrame:
    """Passages of each document at each planned refresh, the start state first.

    `init` (doc_id, revid) and `plan` (doc_id, ts, revid) meet `revisions`
    (revid, passages); refreshes of an unknown revision are kept and marked.
    """
    wanted = plan.select("doc_id", "ts", "revid").unionByName(init.select("doc_id", "revid"), allowMissingColumns=True)
    found = wanted.join(revisions, "revid", "left")
    return found.withColumn("missing", F.col("passages").isNull().cast("int"))


def questions_on_docs(questions, plan, init, revisions, key="doc_id", ts="ts", tie="revid", slice_by=None) -> DataFrame:
    """Each question with the passages of its document's current version, and a mark where there are none.

    A refresh whose revision has no passages is skipped, so the version before it keeps serving.
    """
    served = plan.join(revisions.select("revid"), "revid", "left_semi")
    current = asof_with_default(questions, served, init, key, ts, tie, ["revid"], slice_by)
    return current.join(revisions, "revid", "left").withColumn("missing", F.col("passages").isNull().cast("int"))


def docs_with_edits(docs: DataFrame, edits: DataFrame, on) -> DataFrame:
    """Documents whose title and revision have an edit."""
    on = names(on)
    return docs.join(edits.select(*on).distinct(), on, "left_semi")


def evaluate_plan(events, models, key, t, value, tie, slice_by, step=1) -> DataFrame:
    """Each event under the model in force before it: residual, trend, season value and age."""
    in_force = asof_strict(events, models, key, t, tie, ["trend", "season"], slice_by)
    age = steps_between(t, "feature_ts", step)
    left = residual(value, "trend", "season", t, "feature_ts", step)
    return in_force.select(
        *events.columns, left.alias("pred_residual"), F.col("trend").alias("pred_trend"),
        (F.col(value) - F.col("trend") - left).alias("pred_seasonality"), age.alias("pred_staleness"),
    )


def forecast_eval(queries, models, init, key, t, tie, slice_by) -> DataFrame:
    """Forecast value and age of the newest model at or before each query.

    `init` holds (key, forecast) of the start models, made at time 0.
    """
    newest = asof_with_default(queries, models, init, key, t, tie, ["forecast"], slice_by)
    made = F.coalesce("feature_ts", F.lit(0))
    return newest.select(
        *queries.columns, forecast_at("forecast", t, made).alias("y_pred"), (F.col(t) - made).alias("staleness")
    )
