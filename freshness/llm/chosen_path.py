"""Near-duplicate detection by a chosen-path set similarity join.

Every distinct shingle set gets `COORDINATES` minwise tokens. A tree sends each set down a few random paths: a node picks one or two
coordinates, and its sets go on to one child for each, named by their minwise token there, so that a pair of similarity s is
expected to meet in s / 0.85 children of a node. Ten independent trees start at once, and all their nodes of one depth are a
table (node, set) that is shuffled, counted and branched as a whole.

At the first depth, and every fourth from there, the sets of each node are compared with one of them, the leader. What is similar is
linked, and nodes whose sets all belong to one component are done: large groups of near copies end here. Nodes with few sets outside their largest component
are leaves, and are compared exhaustively in cells of bounded size: first on sketches, then the sets that have a candidate partner
as a whole. All other nodes branch again. Links are confirmed on full sets, 100 * intersection >= 85 * union.

Recall: a pair of similarity 0.85 stays together with probability about 0.87 at each depth, so ten trees miss it with 1e-9 in leaves of depth
1, 2e-5 at depth 3 and 0.4 % at depth 6; sketches of 64 tokens hide it with about 4e-4. More similar pairs are missed
less often. Components can only lose a document if all of its links are missed.

Edge cases: null and wordless texts have an empty set and are linked with nothing; fewer words than a shingle make one shingle of them all;
equal sets are one class; rows that share an id but differ in text are separate; rows with a null id take part, never name a
component (null if all of its ids are null) and are not kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from freshness.llm.components import connected_components
from freshness.llm.set_pairs import key_head, set_key, sets_of, shared, shingle_sets, similar_pairs
from freshness.llm.text import _mix, raw, sliced
from freshness.session import stage

WIDTH = 5
PERCENT = 85
COORDINATES = 64  # minwise tokens of a set
TREES = 10
SECOND = 100 / PERCENT - 1  # share of nodes that pick two coordinates
AGREE = 44  # sketch bytes of 64 that agree in a candidate pair; 85 % of them minus 3.5 standard deviations
OUTSIDE = 2048  # sets outside the largest component of a node, up to which it is a leaf
LED = 4  # depths from one comparison with leaders to the next
CHUNK = 256  # sets of a leaf that are streamed through one cell
HELD = 32 << 20  # bytes of sets that a cell holds
_FACTORS = _mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """32-bit minwise tokens (sets x coordinates) of non-empty sets of 64-bit hashes."""
    tokens = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    least = np.stack([np.minimum.reduceat(tokens * f, starts) for f in _FACTORS], axis=1)
    return (_mix(least) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _profile(source: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, key, head, sig) for each document; key and sig are null for an empty set."""

    def run(batches):
        for batch in sliced(batches):
            sets = list(shingle_sets(raw(batch.column(1)), width))
            full = [s for s in sets if len(s)]
            table = minwise(full).view(np.int32) if full else np.empty((0, COORDINATES), np.int32)
            has = np.array([len(s) > 0 for s in sets], bool)
            offsets = np.concatenate(([0], np.cumsum(has * COORDINATES))).astype(np.int32)
            keys = [set_key(s) if len(s) else None for s in sets]
            sig = pa.ListArray.from_arrays(pa.array(offsets), pa.array(table.ravel()), mask=pa.array(~has))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                 pa.array([None if k is None else key_head(k) for k in keys], pa.int64()), sig],
                names=["doc_id", "n", "key", "head", "sig"])

    return source.mapInArrow(run, "doc_id long, n long, key binary, head long, sig array<int>")


def _roots() -> list[tuple[int, int]]:
    """(tree, coordinate) of the first branches, all coordinates different."""
    draw = np.random.default_rng(11)
    order, out = draw.permutation(COORDINATES).tolist(), []
    for tree in range(TREES):
        out += [(tree, order.pop()) for _ in range(1 + (draw.random() < SECOND))]
    return out


def _first_nodes(classes: DataFrame) -> DataFrame:
    """(node, key) at depth 1."""
    paths = [F.xxhash64(F.lit(tree), F.lit(c), F.col("sig")[c]) for tree, c in _roots()]
    return classes.select("key", F.explode(F.array(*paths)).alias("node"))


def _branch(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, key) of the children: each node picks one coordinate, or two."""
    pick = F.xxhash64("node", F.lit(1))
    one = F.pmod(pick, F.lit(COORDINATES)).cast("int")
    two = F.pmod(one + 1 + F.pmod(F.shiftrightunsigned(pick, 20), F.lit(COORDINATES - 1)), F.lit(COORDINATES)).cast("int")
    both = F.pmod(F.xxhash64("node", F.lit(2)), F.lit(1000)) < int(1000 * SECOND)
    picked = members.select("node", "key", F.explode(F.when(both, F.array(one, two)).otherwise(F.array(one))).alias("c"))
    return picked.join(classes.select("key", "sig"), "key").select("key", F.xxhash64("node", "c", F.expr("sig[c]")).alias("node"))


def _sketches(classes: DataFrame) -> DataFrame:
    """(key, n, sketch): a byte of every minwise token."""

    def run(batches):
        for batch in batches:
            table = np.asarray(batch.column(2).flatten(), np.int32).astype(np.uint8)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(COORDINATES), len(batch), [None, pa.py_buffer(table.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed.cast(pa.binary())], names=["key", "n", "sketch"])

    return classes.select("key", "n", "sig").mapInArrow(run, "key binary, n long, sketch binary")


def _agreeing(x: pa.Array, y: pa.Array) -> pa.Array:
    flat = lambda c: np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, COORDINATES)
    return pa.array((flat(x) == flat(y)).sum(axis=1) >= AGREE)


def _leader_pairs(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b): sets and the leaders of their nodes whose sizes and sketches allow the similarity."""
    leaders = members.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("b")).where("size > 1").select("node", "b")
    met = members.join(leaders, "node").where("key <> b").select(F.col("key").alias("a"), "b").distinct()
    side = lambda s: sketches.select(F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    sized = met.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    return sized.where(F.arrow_udf(_agreeing, "boolean")("sketch_a", "sketch_b")).select("a", "b")


def _mixed(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members (node, key, comp, size, high, main) of the nodes whose sets belong to several components; `main` is the largest one, of `high` sets."""
    placed = members.join(parts.withColumnRenamed("node", "key"), "key", "left").select("node", "key", F.coalesce("component", "key").alias("comp"))
    counts = placed.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("c"))
    nodes = counts.groupBy("node").agg(F.sum("c").alias("size"), F.max(F.struct("c", "comp")).alias("top"))
    nodes = nodes.where("top.c < size").select("node", "size", F.col("top.c").alias("high"), F.col("top.comp").alias("main"))
    return placed.join(nodes, "node")


def _cells(leaves: DataFrame, weight: str) -> DataFrame:
    """(node, chunk, part, kind, key, comp) for each set of each cell of the leaves (`_mixed` members with a `weight` in bytes).

    The sets of a leaf are dealt into chunks and streamed (kind 1) past those outside its largest component, which are sent
    to every chunk and held (kind 0), in parts if they are large. So each pair of different components meets, and rows grow with the leaf.
    """
    outside = F.col("comp") != F.col("main")
    held = leaves.where(outside).groupBy("node").agg(F.ceil(F.sum(weight) / HELD).alias("parts"))
    shaped = leaves.join(held, "node").withColumn("chunks", F.ceil(F.col("size") / CHUNK))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own_chunk, own_part = F.pmod(F.xxhash64("key"), F.col("chunks")), F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts"))
    place = lambda chunk, part, kind: F.struct(chunk.alias("chunk"), part.alias("part"), F.lit(kind).alias("kind"))
    streamed = F.transform(upto("parts"), lambda part: place(own_chunk, part, 1))
    kept = F.when(outside, F.transform(upto("chunks"), lambda chunk: place(chunk, own_part, 0))).otherwise(F.array().cast("array<struct<chunk:bigint,part:bigint,kind:int>>"))
    return shaped.select("node", "key", "comp", F.explode(F.concat(streamed, kept)).alias("at")).select("node", "at.chunk", "at.part", "at.kind", "key", "comp")


def _by_cell(batches, columns: int):
    """(cell, kind, rows) for consecutive rows of one cell (node, chunk, part) and kind; a stretch may come in several pieces."""
    for batch in batches:
        marks = [np.asarray(batch.column(i)) for i in range(4)]
        cuts = np.flatnonzero(np.any([np.diff(m) != 0 for m in marks], axis=0)) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
            if start < stop:
                yield tuple(int(m[start]) for m in marks[:3]), int(marks[3][start]), [batch.column(i).slice(start, stop - start) for i in range(4, columns)]


def _allowed(n: int, sizes: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(sizes, n) >= PERCENT * np.maximum(sizes, n)


def _homes(leaves: DataFrame) -> DataFrame:
    """(key, homes): the leaves of each set, a few for each tree, in order. A pair belongs to the first that both have, so it is compared once."""
    return leaves.groupBy("key").agg(F.array_sort(F.collect_set("node")).alias("homes"))


def _open_leaves(leaves: DataFrame, sketches: DataFrame) -> DataFrame:
    """(node, key): sets that have a candidate partner of another component in a leaf, by sketch."""
    cells = _cells(leaves.withColumn("weight", F.lit(COORDINATES)), "weight").join(sketches, "key").join(_homes(leaves), "key")
    cells = cells.select("node", "chunk", "part", "kind", "key", "comp", "n", "sketch", "homes").repartition("node", "chunk", "part")

    def run(batches):
        cell, held, rows = None, [], 0
        for at, kind, (keys, comps, sizes, sketch, homes) in _by_cell(batches, 9):
            if at != cell:
                cell, held = at, []
            table = np.frombuffer(b"".join(sketch.to_pylist()), np.uint8).reshape(-1, COORDINATES)
            entries = (keys.to_pylist(), np.array(comps.to_pylist(), object), np.asarray(sizes), table, homes.to_pylist())
            if kind == 0:
                held += zip(*entries)
                continue
            names, groups, sizes, table, homes = entries
            open_ = set()
            for key, comp, n, mine, home in held:
                ok = ((table == mine).sum(axis=1) >= AGREE) & (groups != comp) & _allowed(n, sizes)
                home = set(home)
                for j in np.flatnonzero(ok).tolist():
                    if next(h for h in homes[j] if h in home) == at[0]:
                        open_.update((key, names[j]))
            if open_:
                yield pa.RecordBatch.from_arrays([pa.array([at[0]] * len(open_), pa.int64()), pa.array(sorted(open_), pa.binary())], names=["node", "key"])

    return cells.sortWithinPartitions("node", "chunk", "part", "kind").mapInArrow(run, "node long, key binary").distinct()


def _leaf_links(source: DataFrame, classes: DataFrame, leaves: DataFrame, width: int) -> DataFrame:
    """Links (a, b) that connect the components of leaves; `leaves` are `_mixed` members, compared on whole sets cell by cell."""
    sized = leaves.join(classes.select("key", "n"), "key").withColumn("weight", F.col("n") * 8)
    places = stage(_cells(sized, "weight"))
    sets, wanted = sets_of(source, classes, places.select("key").distinct(), width)
    cells = places.join(sets, "key").join(_homes(leaves), "key").select("node", "chunk", "part", "kind", "key", "comp", "tokens", "homes")

    def run(batches):
        cell, held, root, table, sizes = None, [], {}, None, None

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for at, kind, (keys, comps, sets, homes) in _by_cell(batches, 8):
            if at != cell:
                cell, held, root, table, sizes = at, [], {}, np.empty((0, COORDINATES), np.uint8), np.empty(0, np.int64)
            tokens = [np.frombuffer(packed, np.uint64) for packed in sets.to_pylist()]
            mine, theirs = minwise(tokens).astype(np.uint8), np.array([len(t) for t in tokens])
            if kind == 0:
                held += zip(keys.to_pylist(), comps.to_pylist(), tokens, map(set, homes.to_pylist()))
                table, sizes = np.concatenate((table, mine)), np.concatenate((sizes, theirs))
                continue
            left, right = [], []
            for key, comp, whole, sketch, home in zip(keys.to_pylist(), comps.to_pylist(), tokens, mine, homes.to_pylist()):
                for i in np.flatnonzero(((table == sketch).sum(axis=1) >= AGREE) & _allowed(len(whole), sizes)).tolist():
                    other, apart, hub, known = held[i]
                    if find(comp) == find(apart) or next(h for h in home if h in known) != at[0]:
                        continue
                    both = shared(hub, whole)
                    if 100 * both >= PERCENT * (len(hub) + len(whole) - both):
                        root[find(comp)] = find(apart)
                        left.append(key)
                        right.append(other)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    ordered = cells.repartition("node", "chunk", "part").sortWithinPartitions("node", "chunk", "part", "kind")
    found = stage(ordered.mapInArrow(run, "a binary, b binary"))
    wanted.destroy()
    return found


def link_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `docs`."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profile = stage(_profile(source, width))
    classes = stage(profile.where("key is not null").groupBy("key").agg(F.first("n").alias("n"), F.first("head").alias("head"), F.first("sig").alias("sig")))
    sketches = stage(_sketches(classes))
    links = tested = source.sparkSession.createDataFrame([], "a binary, b binary")
    parts = source.sparkSession.createDataFrame([], "node binary, component binary")

    frontier, leaves, depth = stage(_first_nodes(classes)), [], 0
    while True:
        if depth % LED == 0:
            new = stage(_leader_pairs(frontier, sketches).join(tested, ["a", "b"], "left_anti"))
            if not new.isEmpty():
                links = links.unionByName(similar_pairs(source, classes, new, PERCENT, width))
                tested = tested.unionByName(new)
                parts = stage(connected_components(links))
        depth += 1
        mixed = stage(_mixed(frontier, parts))
        leaves.append(mixed.where(F.col("size") - F.col("high") <= OUTSIDE).select("node", "key"))
        large = mixed.where(F.col("size") - F.col("high") > OUTSIDE)
        if large.isEmpty():
            break
        frontier = stage(_branch(large.select("node", "key"), classes))
    together = leaves[0]
    for more in leaves[1:]:
        together = together.unionByName(more)
    open_ = stage(_open_leaves(stage(_mixed(together, parts)), sketches))
    if not open_.isEmpty():
        links = links.unionByName(_leaf_links(source, classes, _mixed(open_, parts), width))
        parts = stage(connected_components(links))

    rows = profile.join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = rows.where("key is not null").groupBy("component").agg(F.min("doc_id").alias("first"))
    out = rows.select("doc_id", "n", "component").join(named, "component", "left")
    component_id = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("first"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.coalesce(F.col("doc_id") == component_id, F.lit(False)).alias("kept"))
