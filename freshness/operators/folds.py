"""Ordered gradient folds over histories of any length, as a prefix scan of affine maps.

A step u + lr ((y - u'm) m - reg u) is affine in u. A history is cut into blocks
of bounded length. Every block that has a follower becomes one map (A, b), on its
own task; maps of `fan` blocks are composed, and again those of `fan` groups, so
the vector in front of every group, then of every block, follows from few maps.
With these starts all blocks are walked at once. One path for all sizes: a
history of one block makes no map and is only walked. No list of events or maps
is ever built; rows come sorted and are read as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from freshness.operators.ordered import columns, with_running
from freshness.session import stage

Frames, Batches = Iterator[pd.DataFrame], Iterator[pa.RecordBatch]
_VECTOR = "array<double>"


def _whole_groups(batches: Batches, keys: list[str]) -> Iterator[pa.Table]:
    """The same sorted rows in tables that cut no group."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        if not len(table):
            continue
        cut = _starts_of_groups(table, keys)[-1]
        held = table.slice(cut)
        if cut:
            yield table.slice(0, cut)
    if held is not None:
        yield held


def _starts_of_groups(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(table), bool)
    new[0] = True
    for key in keys:
        col = table[key].to_numpy()
        new[1:] |= col[1:] != col[:-1]
    return np.flatnonzero(new)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    sizes = pc.list_value_length(column).to_numpy()
    if (sizes != sizes[0]).any():
        raise ValueError("vectors differ in length")
    return pc.list_flatten(column).to_numpy().astype(float).reshape(len(sizes), -1)


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for k, v in columns.items()})


def _lists(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).ravel()))


def _by_position(first: np.ndarray, rows: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Group number of each of `rows` rows, and the rows that stand first in their groups, second, and so on."""
    lengths = np.diff(np.append(first, rows))
    group = np.repeat(np.arange(len(first)), lengths)
    position = np.arange(rows) - first[group]
    order = np.argsort(position, kind="stable")
    return group, np.split(order, np.cumsum(np.bincount(position))[:-1])


def _block_maps(user: str, lr: np.ndarray, reg: np.ndarray):
    keep = 1 - lr * reg

    def run(batches: Batches) -> Batches:
        for table in _whole_groups(batches, [user, "_block"]):
            first = _starts_of_groups(table, [user, "_block"])
            group, steps = _by_position(first, len(table))
            x, y = _matrix(table["_v"]), table["_y"].to_numpy()
            d, n = x.shape[1], group[-1] + 1
            a = np.tile(np.eye(d), (n, len(lr), 1, 1))
            b = np.zeros((n, len(lr), d))
            for rows in steps:
                g, m = group[rows], x[rows]
                along = np.einsum("kd,kpde->kpe", m, a[g])
                a[g] = keep[:, None, None] * a[g] - lr[:, None, None] * m[:, None, :, None] * along[:, :, None, :]
                miss = y[rows][:, None] - np.einsum("kd,kpd->kp", m, b[g])
                b[g] = keep[:, None] * b[g] + (lr * miss)[:, :, None] * m[:, None, :]
            heads = table.select([user, "_block"]).take(first).combine_chunks()
            for p in range(len(lr)):
                yield _batch(
                    {user: heads[user], "_p": pa.array(np.full(n, p, np.int32)), "_block": heads["_block"],
                     "_a": _lists(a[:, p].reshape(n, d * d)), "_b": _lists(b[:, p])}
                )

    return run


def _compose(user: str):
    """Maps in order, as one map for each group."""

    def run(frames: Frames) -> Frames:
        at, a, b = None, None, None

        def done():
            return pd.DataFrame({user: [at[0]], "_p": [at[1]], "_block": [at[2]], "_a": [a.ravel()], "_b": [b]})

        for frame in frames:
            for key, flat, shift in zip(zip(frame[user], frame["_p"], frame["_group"]), frame["_a"], frame["_b"]):
                shift = np.asarray(shift, dtype=float)
                step = np.asarray(flat, dtype=float).reshape(len(shift), -1)
                if key == at:
                    a, b = step @ a, step @ b + shift
                else:
                    if at is not None:
                        yield done()
                    at, a, b = key, step, shift
        if at is not None:
            yield done()

    return run


def _apply(user: str):
    """The vector after each map; a group opens with a row that holds its start instead of a map."""

    def run(frames: Frames) -> Frames:
        u = None
        for frame in frames:
            ends = []
            for flat, shift in zip(frame["_a"], frame["_b"]):
                shift = np.asarray(shift, dtype=float)
                u = shift if flat is None else np.asarray(flat, dtype=float).reshape(len(shift), -1) @ u + shift
                ends.append(u)
            maps = frame["_block"].to_numpy() >= 0
            if maps.any():
                yield frame.loc[maps, [user, "_p", "_block"]].assign(_u=[e for e, m in zip(ends, maps) if m])

    return run


def _walk(user: str, lr: np.ndarray, reg: np.ndarray):
    """Events of each block from its starts; the vectors before and after each stretch of one tag.

    A block opens with rows of negative `_rn`: a start for each parameter, or one for all of them in block 0. One without is left out.
    """
    count = len(lr)

    def run(batches: Batches) -> Batches:
        for table in _whole_groups(batches, [user, "_block"]):
            opens = table["_rn"].to_numpy() < 0
            first = _starts_of_groups(table, [user, "_block"])
            known = np.repeat(opens[first], np.diff(np.append(first, len(table))))
            if not known.all():
                table, opens = table.filter(pa.array(known)), opens[known]
                if not len(table):
                    continue
                first = _starts_of_groups(table, [user, "_block"])
            copies = np.where(opens & (table["_block"].to_numpy() == 0), count, 1)
            source = np.repeat(np.arange(len(table)), copies)
            group, steps = _by_position((np.cumsum(copies) - copies)[first], len(source))
            x, y, tag = _matrix(table["_v"])[source], table["_y"].to_numpy()[source], table["_tag"].to_numpy()[source]
            last = np.ones(len(source), bool)
            last[:-1] = (tag[1:] != tag[:-1]) | (group[1:] != group[:-1])
            u = np.zeros((group[-1] + 1, count, x.shape[1]))
            before, hits, was, now = None, [], [], []
            for i, rows in enumerate(steps):
                g, v = group[rows], x[rows]
                if i < count:
                    u[g, i] = v
                    continue
                if before is None:
                    before = u.copy()
                miss = y[rows][:, None] - np.einsum("kd,kpd->kp", v, u[g])
                u[g] += lr[:, None] * (miss[:, :, None] * v[:, None, :] - reg[:, None] * u[g])
                ends = last[rows]
                hit, at = rows[ends], g[ends]
                hits.append(hit)
                was.append(before[at])
                now.append(u[at])
                before[at] = u[at]
            if hits:
                hits, was, now = np.concatenate(hits), np.concatenate(was), np.concatenate(now)
                users, tags = table[user].take(pa.array(source[hits])), pa.array(tag[hits])
                for p in range(count):
                    yield _batch({user: users, "_p": pa.array(np.full(len(hits), p, np.int32)), "_tag": tags,
                                  "_before": _lists(was[:, p]), "_after": _lists(now[:, p])})

    return run


def _sorted(rows: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, by)


def block_ends(maps: DataFrame, begin: DataFrame, user: str, fan: int, levels: int) -> DataFrame:
    """The vector after each block of `maps` (user, _p, _block, _a, _b), from `begin` (user, _p, _u).

    A group of `fan` maps is composed into one, `levels` times; the top level applies a user's remaining maps in order.
    """
    kind = maps.schema[user].dataType.simpleString()
    grouped = maps.withColumn("_group", (F.floor(F.col("_block") / fan) if levels else F.lit(0)).cast("long"))
    starts = begin.select(user, "_p", F.lit(0).cast("long").alias("_group"), "_u")
    if levels:
        shape = f"{user} {kind}, _p int, _block long, _a {_VECTOR}, _b {_VECTOR}"
        sums = _sorted(grouped, [user, "_p", "_group"], "_block").mapInPandas(_compose(user), shape)
        ends = block_ends(sums, begin, user, fan, levels - 1)
        starts = starts.unionByName(ends.select(user, "_p", (F.col("_block") + 1).alias("_group"), "_u"))
    opening = starts.select(user, "_p", "_group", F.lit(-1).cast("long").alias("_block"), F.lit(None).cast(_VECTOR).alias("_a"), F.col("_u").alias("_b"))
    rows = _sorted(grouped.unionByName(opening), [user, "_p", "_group"], "_block")
    return rows.mapInPandas(_apply(user), f"{user} {kind}, _p int, _block long, _u {_VECTOR}")


def fold_scan(
    events: DataFrame, users: DataFrame, user: str, order, vector: str, rating: str, params: Sequence[tuple[float, float]],
    slice_by, user_vec: str, tag: Column | None = None, block_rows: int = 1_024, fan: int = 1_024, levels: int = 1, staged: bool = False,
) -> DataFrame:
    """Fold every user's events, in order, over the start vector, once for each (lr, reg) of `params`.

    Returns (user, _p, _tag, _before, _after): the vectors before and after each stretch of events with one `tag` (which
    never decreases along the order); a stretch that spans blocks gives one row for each. Without a tag only the vector
    after the last event comes out, and only last blocks are walked. Events without user, rating or vector change
    nothing; users that `users` does not have are left out. `slice_by` places the events as in `with_running`.

    Events of users with one block are numbered by nothing and shuffled once, to the walk, where users without a start drop out; those of
    longer users are numbered first. `staged`: the events are stored already and cheap to read again.
    """
    lr, reg = (np.array(v, dtype=float) for v in zip(*params))
    known = users.where(F.col(user).isNotNull() & F.col(user_vec).isNotNull()).select(user, F.col(user_vec).alias("_u"))
    rows = events.where(F.col(user).isNotNull() & F.col(vector).isNotNull() & F.col(rating).isNotNull())
    by = columns(order)
    places = [f"_o{i}" for i in range(len(by))]
    tagged = F.lit(0) if tag is None else tag
    rows = rows.select(
        user, tagged.cast("long").alias("_tag"), F.col(rating).cast("double").alias("_y"), F.col(vector).cast(_VECTOR).alias("_v"),
        (F.col(slice_by) if isinstance(slice_by, str) else slice_by).alias("_at"), *[c.alias(o) for c, o in zip(by, places)],
    )
    rows = rows if staged else stage(rows)
    sizes = rows.groupBy(user).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows)
    long_users = stage(sizes.join(known.select(user, F.lit(True).alias("_known")).distinct(), user, "left").select(user, "_known"))
    zero = F.lit(0).cast("long")
    short = rows.join(long_users.select(user), user, "left_anti").select(user, zero.alias("_rn"), zero.alias("_block"), "_tag", "_y", "_v", *places)

    one = ("count", F.lit(1))
    placed = with_running(rows.join(long_users.where("_known").select(user), user, "left_semi"), user, places, "_at", {"_rn": one}, {"_n": one})
    block_of = lambda c: F.floor((F.col(c) - 1) / block_rows).cast("long")
    placed = stage(placed.select(user, "_rn", block_of("_rn").alias("_block"), block_of("_n").alias("_final"), "_tag", "_y", "_v"))
    kind = events.schema[user].dataType.simpleString()
    shape = f"{user} {kind}, _p int, _block long, _a {_VECTOR}, _b {_VECTOR}"
    followed = _sorted(placed.where("_block < _final").drop("_final"), [user, "_block"], "_rn")
    maps = stage(followed.mapInArrow(_block_maps(user, lr, reg), shape))
    begin = known.select(user, F.explode(F.array(*[F.lit(p) for p in range(len(lr))])).alias("_p"), "_u")
    long_ones = begin.join(maps.select(user).distinct(), user, "left_semi")
    ends = block_ends(maps, long_ones, user, fan, levels)

    opening = lambda starts, p, block: starts.select(
        user, (p - len(lr)).cast("long").alias("_rn"), block.cast("long").alias("_block"), F.lit(-1).cast("long").alias("_tag"),
        F.lit(0.0).alias("_y"), F.col("_u").cast(_VECTOR).alias("_v"),
    )
    walked = (placed.where("_block = _final") if tag is None else placed).drop("_final")
    both = short
    for part in (walked, opening(known, F.lit(0), F.lit(0)), opening(ends, F.col("_p"), F.col("_block") + 1)):
        both = both.unionByName(part, allowMissingColumns=True)
    both = both.repartition(user, "_block").sortWithinPartitions(user, "_block", "_rn", *places)
    return both.mapInArrow(_walk(user, lr, reg), f"{user} {kind}, _p int, _tag long, _before {_VECTOR}, _after {_VECTOR}")
