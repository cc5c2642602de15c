"""Hard-negative mining with exact integer scores from a residue number system.

Vectors become integers (floor(scale * x)). Every component is reduced modulo a few small primes; matrix products of the residues
in float32 are exact, as their sums stay below 2^24, and the Chinese remainder theorem (mixed radix) gives the signed inner
products of an anchor block with a row block. As many primes are taken as the norms ask for (Cauchy-Schwarz).

Every anchor meets every row: anchors are cut into groups, rows into slices, and a task streams a slice in
runs of rows past one group, holding only the best few of each anchor and threshold. The partial lists of
all slices are merged by a windowed selection. The first pass finds the positives, the second the negatives below each of them.

Edge cases: rows with a null id, label or vector, or a null or non-finite component, take no part. Equal rows count once; rows that share an
id but differ are rows of their own, and an anchor's other rows are those that differ from it. Ties go to the smaller id,
then to the smaller row hash. A vector that is shorter than another counts as padded with zeros, an empty one scores 0. An anchor without
positives or negatives gives no rows; an empty table gives none. Vectors so large that a score could
reach 2^54 raise a ValueError before any work. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from freshness.session import stage

# The largest primes below 2^8, so that a centred residue fits into a byte.
PRIMES = (251, 241, 239, 233, 229, 227, 223)
SUMMED = 1024  # products of centred residues whose sum is exact in float32
GROUP_BYTES = 16 << 20  # residues of the anchors that a task holds
GROUP = 65_536  # anchors that a task holds, at most
TASKS = 512  # cells of anchor groups and row slices that a large input is cut into
SLICE = 1024  # rows from which on a slice is worth a task
TILE = 1 << 21  # scores that exist at once
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def quantised(vector: str | Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def primes_for(bound: int) -> tuple[int, ...]:
    """Primes whose product exceeds twice the largest absolute score."""
    product = 1
    for i, p in enumerate(PRIMES, 1):
        product *= p
        if product > 2 * bound + 1:
            return PRIMES[:i]
    raise ValueError(f"scores up to {bound} do not fit {len(PRIMES)} residues")


def residues(matrix: np.ndarray, primes: tuple[int, ...]) -> np.ndarray:
    """Centred residues (prime x row x component) as bytes."""
    return np.stack([((matrix + p // 2) % p - p // 2).astype(np.int8) for p in primes])


def _product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p, in float32 stretches that are exact."""
    out = np.zeros((len(a), len(b)), np.int32)
    for at in range(0, a.shape[1], SUMMED):
        part = a[:, at : at + SUMMED].astype(np.float32) @ b[:, at : at + SUMMED].astype(np.float32).T
        out = (out + part.astype(np.int32)) % p
    return out


def signed_scores(a: np.ndarray, b: np.ndarray, primes: tuple[int, ...]) -> np.ndarray:
    """Exact inner products of all rows of `a` and `b`, given as residues, by mixed-radix reconstruction."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        digit = _product(a[k], b[k], p)
        for q, earlier in zip(primes, digits):
            digit = (digit - earlier) * pow(q, -1, p) % p
        digits.append(digit)
    scores = digits[-1].astype(np.int64)
    for p, digit in zip(primes[-2::-1], digits[-2::-1]):
        scores = scores * p + digit
    whole = math.prod(primes)
    return np.where(scores > whole // 2, scores - whole, scores)


def _dense(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as a matrix, padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.asarray(lists.offsets)
    sizes = np.diff(ends)
    out = np.zeros((len(lists), width), np.int64)
    flat = np.asarray(lists.values, np.int64)[ends[0] : ends[-1]] if len(lists) else np.empty(0, np.int64)
    if len(lists) and (sizes == width).all():
        return flat.reshape(-1, width)
    at = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)
    out[np.repeat(np.arange(len(lists)), sizes), at] = flat
    return out


class _Best:
    """The first `k` rows (score descending, then arrival) of each list; rows arrive by id, so an equal later score never wins."""

    def __init__(self, lists: int, k: int):
        self.k = k
        self.scores = np.full((lists, k), _LOW)
        self.rows = np.zeros((lists, k), np.int64)
        self.ties = np.zeros((lists, k), np.int64)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, ties: np.ndarray) -> None:
        """Merge a block of scores (lists `at` x rows); rows that do not qualify are `_LOW`."""
        floor = self.scores[at, -1]
        hit = scores > floor[:, None]
        if scores.shape[1] > self.k and hit.sum() > 4 * self.k * len(at):
            hit &= scores >= np.partition(scores, -self.k, axis=1)[:, -self.k][:, None]
        i, j = np.nonzero(hit)
        if not len(i):
            return
        touched, i = np.unique(i, return_inverse=True)
        mine = at[touched]
        held = np.repeat(np.arange(len(touched)), self.k)
        which = np.concatenate((held, i))
        value = np.concatenate((self.scores[mine].ravel(), scores[touched[i], j]))
        row = np.concatenate((self.rows[mine].ravel(), ids[j]))
        tie = np.concatenate((self.ties[mine].ravel(), ties[j]))
        order = np.lexsort((np.arange(len(which)), -np.maximum(value, -_HIGH), which))  # what is held came earlier
        which = which[order]
        place = np.arange(len(which)) - np.searchsorted(which, which)
        first = order[place < self.k]
        self.scores[mine] = value[first].reshape(-1, self.k)
        self.rows[mine] = row[first].reshape(-1, self.k)
        self.ties[mine] = tie[first].reshape(-1, self.k)


def _stream(primes: tuple[int, ...], width: int, k: int, thresholds: bool, share: tuple[int, int]):
    """A function over sorted batches (cell, kind, vec_id, tie, label, q, limits): the best rows of each anchor of a cell.

    Kind 0 rows are the anchors of the cell, kind 1 rows its slice of the table. Without thresholds rows of the anchor's label
    compete, else rows of other labels, for each limit p those with share[0] * p <= share[1] * score <= share[1] * p.
    """

    def finish(anchors, best) -> Iterator[pa.RecordBatch]:
        ids, ties, _, _, lists = anchors
        owner = lists[:, 0]
        for at in range(0, len(owner), 1 << 16):
            found = best.scores[at : at + (1 << 16)] != _LOW
            i, j = np.nonzero(found)
            i += at
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[owner[i]]), pa.array(ties[owner[i]]), pa.array(lists[i, 1] if thresholds else np.zeros(len(i), np.int64)),
                 pa.array(best.rows[i, j]), pa.array(best.ties[i, j]), pa.array(best.scores[i, j])],
                names=["anchor_id", "anchor_tie", "bound", "vec_id", "tie", "score"])

    def open_cell(parts) -> tuple:
        ids, ties, labels, matrix, limits = _joined(parts)
        if thresholds:
            lists = np.array([(i, p) for i, ps in enumerate(limits) for p in ps], np.int64).reshape(-1, 2)
        else:
            lists = np.stack((np.arange(len(ids)), np.zeros(len(ids), np.int64)), axis=1)
        return (ids, ties, labels, residues(matrix, primes), lists), _Best(len(lists), k)

    def compare(anchors, best, ids, ties, labels, matrix) -> None:
        a_ids, a_ties, a_labels, a_res, lists = anchors
        rows = residues(matrix, primes)
        step = max(1, TILE // len(ids))
        for at in range(0, len(a_ids), step):
            end = min(at + step, len(a_ids))
            scores = signed_scores(a_res[:, at:end], rows, primes)
            same = a_labels[at:end, None] == labels[None, :]
            if not thresholds:
                itself = (a_ids[at:end, None] == ids[None, :]) & (a_ties[at:end, None] == ties[None, :])
                best.add(np.arange(at, end), np.where(same & ~itself, scores, _LOW), ids, ties)
                continue
            scores = np.where(same, _LOW, scores)
            low, high = np.searchsorted(lists[:, 0], (at, end))
            for start in range(low, high, step):
                mine = lists[start : min(start + step, high)]
                p = mine[:, 1][:, None]
                least = -((-share[0] * p) // share[1])
                s = scores[mine[:, 0] - at]
                best.add(np.arange(start, start + len(mine)), np.where((s >= least) & (s <= p), s, _LOW), ids, ties)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, anchors, best = None, [], None, None
        for batch in batches:
            cells, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
                if start == stop:
                    continue
                piece = batch.slice(start, stop - start)
                if cells[start] != cell:
                    if best is not None:
                        yield from finish(anchors, best)
                    cell, parts, anchors, best = cells[start], [], None, None
                columns = [np.asarray(piece.column(i)) for i in (2, 3, 4)] + [_dense(piece.column(5), width)]
                if kinds[start] == 0:
                    parts.append((*columns, piece.column(6).to_pylist()))
                    continue
                if best is None:
                    if not parts:
                        continue  # a slice whose anchor group is empty
                    anchors, best = open_cell(parts)
                    parts = []
                compare(anchors, best, *columns)
        if best is not None:
            yield from finish(anchors, best)

    return run


def _joined(parts):
    ids, ties, labels, matrix, limits = zip(*parts)
    return (*(np.concatenate(x) for x in (ids, ties, labels, matrix)), [p or [] for part in limits for p in part])


def _search(rows: DataFrame, anchors: DataFrame, primes: tuple[int, ...], width: int, k: int, thresholds: bool, share: tuple[int, int], groups: int, slices: int) -> DataFrame:
    """(anchor_id, anchor_tie, bound, vec_id, tie, score): the best `k` rows of each slice for each anchor and bound."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = anchors.select(F.pmod("tie", F.lit(groups)).cast("int").alias("g"), "vec_id", "tie", "label", "q", "limits").select("*", each(slices).alias("s"))
    given = rows.select(F.pmod(F.xxhash64("tie"), F.lit(slices)).cast("int").alias("s"), "vec_id", "tie", "label", "q").select("*", each(groups).alias("g"))
    columns = [(F.col("g") * slices + F.col("s")).alias("cell"), "kind", "vec_id", "tie", "label", "q", "limits"]
    both = asked.withColumn("kind", F.lit(0)).select(*columns).unionByName(
        given.withColumns({"kind": F.lit(1), "limits": F.lit(None).cast("array<long>")}).select(*columns))
    ordered = both.repartition(groups * slices, "cell").sortWithinPartitions("cell", "kind", "vec_id", "tie")
    found = ordered.mapInArrow(
        _stream(primes, width, k, thresholds, share), "anchor_id long, anchor_tie long, bound long, vec_id long, tie long, score long")
    place = F.row_number().over(W.partitionBy("anchor_id", "anchor_tie", "bound").orderBy(F.desc("score"), "vec_id", "tie"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def mine_hard_negatives(
    vectors: DataFrame, is_anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100),
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each anchor (rows where `is_anchor`, a column over `vec_id`) the first `positives` other rows of its label, and for each of them the first
    `negatives` rows of other labels with share[0] * positive <= share[1] * negative <= share[1] * positive; higher scores
    come first, ties by smaller id.
    """
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    given = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    given = given.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(usable)
    norm = F.aggregate(F.transform("embedding", lambda x: F.floor(x * scale).cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    rows = given.select("vec_id", "label", quantised("embedding", scale).alias("q"), norm.alias("norm"))
    rows = stage(rows.withColumn("tie", F.xxhash64("vec_id", "label", "q")).dropDuplicates(["vec_id", "label", "tie"]))
    anchor = F.coalesce(is_anchor, F.lit(False))
    shape = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(anchor).alias("anchors"), F.max(F.size("q")).alias("width"), F.max("norm").alias("high"),
        F.max(F.when(anchor, F.col("norm"))).alias("anchor_high")).first()
    high = math.sqrt(shape.high or 0.0) * math.sqrt(shape.anchor_high or 0.0) * 1.000001 + 1
    if high >= 1 << 54:
        raise ValueError(f"scores up to {high:.3g} are too large")
    primes, width = primes_for(math.ceil(high)), max(1, shape.width or 0)
    group = max(1, min(GROUP, GROUP_BYTES // (width * len(primes))))
    groups = max(1, math.ceil(shape.anchors / group))
    slices = max(1, min(math.ceil(TASKS / groups), math.ceil(shape.rows / SLICE)))
    asking = rows.where(anchor)
    found = _search(rows, asking.withColumn("limits", F.lit(None).cast("array<long>")), primes, width, positives, False, share, groups, slices)
    best = stage(found.select("anchor_id", "anchor_tie", F.col("vec_id").alias("positive_id"), F.col("score").alias("bound")))
    limits = best.groupBy("anchor_id", "anchor_tie").agg(F.array_sort(F.collect_set("bound")).alias("limits"))
    limited = asking.join(limits, (F.col("vec_id") == F.col("anchor_id")) & (F.col("tie") == F.col("anchor_tie"))).drop("anchor_id", "anchor_tie")
    hard = _search(rows, limited, primes, width, negatives, True, share, groups, slices)
    return best.join(hard, ["anchor_id", "anchor_tie", "bound"]).select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("bound").alias("positive_score"),
        F.col("score").alias("negative_score"))
