"""N-gram Jaccard join by a token-group matrix.

Documents with the same shingle set are one class. Classes that share their smallest shingle (in one of a few random orders) and are
similar to one leader are connected, and what is connected makes a group; every other class is a group of its own. The matrix has a
row for each (token, class) of the rarest tokens of each set, with the class's group. A token whose classes all belong to one group is
settled, and tokens with the same classes are one with a weight. The classes of groups that meet in one of the others are dealt into cells
of bounded size, where the overlap of each two is bounded by the weights of the tokens that they share; only classes that
qualify are opened, and compared on whole sets, again cell by cell.

Exactness: two sets of similarity 0.8 share one of their rarest fifth of tokens, in any fixed order of all tokens (here: by counts of
hashed buckets over all documents, then by hash). The matrix therefore holds those tokens only, and no similar pair is lost. A pair
that meets in several tokens belongs to the one with the longest list, so it is compared once. Only links between
groups are sought, and a cell stops asking once it has connected two groups itself; components lose nothing by that.

Edge cases: null and wordless texts have an empty set and are linked with nothing; fewer words than a
shingle make one shingle of them all; repeated rows are one class; rows that share an id but differ in text are separate; rows with a null id
take part, but never name a component (null if all of its ids are null); ties do not matter; very long texts are hashed in slabs; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from freshness.llm.components import connected_components
from freshness.llm.set_pairs import giving_back, key_head, set_key, sets_of, shared, shingle_sets, similar_pairs
from freshness.llm.text import _mix, raw, sliced
from freshness.session import stage

WIDTH = 5
PERCENT = 80
BUCKETS, CHUNKS = 1 << 20, 64  # token counts by hash; 4 MB, whatever the input
TASK_BLOCK = 256  # tasks whose counts are added up in one group
ORDERS = 3  # random orders of tokens in which classes may share their smallest one
LARGE = 8  # classes that share their smallest shingle, from which on a leader is sought
SALTED = 1024  # classes that are compared with one leader
HOMES = 16  # tokens of a class by which pairs that meet again are recognised
STREAMED, MOST = 256, 64  # classes of a list that are streamed through one cell, and chunks of a list at most
HELD = 32 << 20  # bytes of sets that a cell holds


def prefix_length(n):
    """Tokens of which one must be shared with any set of similarity 0.8: n - ceil(0.8 n) + 1."""
    return n - (4 * n + 4) // 5 + 1


def _order(tokens: np.ndarray, i: int) -> np.ndarray:
    """The tokens' places in one of a few fixed random orders."""
    return tokens if i == 0 else _mix(tokens ^ np.uint64(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _profile(source: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, key, head, smallest) for each document, and (chunk, counts): token counts by bucket for each task."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in sliced(batches):
            ids, sizes, keys, heads, least, buckets = batch.column(0), [], [], [], [], []
            for tokens in shingle_sets(raw(batch.column(1)), width):
                sizes.append(len(tokens))
                keys.append(set_key(tokens))
                heads.append(key_head(keys[-1]))
                least.append([int(_order(tokens, i).min().astype(np.int64)) for i in range(ORDERS)] if len(tokens) else None)
                buckets.append((tokens >> np.uint64(44)).astype(np.int32))
            counts += np.bincount(np.concatenate(buckets), minlength=BUCKETS) if buckets else 0
            none = pa.nulls(len(sizes))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(heads, pa.int64()), pa.array(least, pa.list_(pa.int64())),
                 none.cast(pa.int32()), none.cast(pa.binary())], names=NAMES)
        if counts.any():
            packed = [zlib.compress(part.tobytes(), 1) for part in np.split(counts, CHUNKS)]
            block = TaskContext.get().partitionId() // TASK_BLOCK
            none = pa.nulls(CHUNKS)
            yield pa.RecordBatch.from_arrays(
                [none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.int64()), none.cast(pa.list_(pa.int64())),
                 pa.array(range(block * CHUNKS, (block + 1) * CHUNKS), pa.int32()), pa.array(packed, pa.binary())], names=NAMES)

    NAMES = ["doc_id", "n", "key", "head", "smallest", "chunk", "counts"]
    return source.mapInArrow(giving_back(run), "doc_id long, n long, key binary, head long, smallest array<long>, chunk int, counts binary")


def _bucket_counts(profile: DataFrame) -> np.ndarray:
    """Counts of all documents' tokens by bucket: 2^20 numbers, summed by Spark over blocks of tasks and then over the blocks."""

    def add(key, table):
        total = sum(np.frombuffer(zlib.decompress(c), np.int64) for c in table["counts"].to_pylist())
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = "chunk int, counts binary"
    blocks = profile.where("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInArrow(add, schema)
    rows = blocks.withColumn("chunk", F.col("chunk") % CHUNKS).groupBy("chunk").applyInArrow(add, schema).toArrow()
    out = np.zeros((CHUNKS, BUCKETS // CHUNKS), np.int64)
    for chunk, counts in zip(rows["chunk"].to_pylist(), rows["counts"].to_pylist()):
        out[chunk] = np.frombuffer(zlib.decompress(counts), np.int64)
    return out.reshape(-1)


def rare_first(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The prefix of a set in the order of bucket counts, then hashes."""
    order = np.argsort(counts[(tokens >> np.uint64(44)).astype(np.int64)], kind="stable")
    return tokens[order[: prefix_length(len(tokens))]]


def _leaders(source: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(a, b): classes similar to a leader, and that leader.

    In each of a few orders, classes with the same smallest token are compared with one of them, if there are `LARGE` or
    more. Very many are dealt to several leaders by hash, differently in each order, so no leader meets more than about
    `SALTED` sets and copies of one text meet all the same.
    """
    rows = classes.select("key", F.posexplode("smallest").alias("i", "token"))
    large = rows.groupBy("i", "token").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= LARGE)
    dealt = rows.join(large, ["i", "token"]).select("i", "token", "key", F.pmod(F.xxhash64("key", "i"), F.ceil(F.col("size") / SALTED)).alias("salt"))
    dealt = stage(dealt)
    first = dealt.groupBy("i", "token", "salt").agg(F.min("key").alias("b"))
    pairs = stage(dealt.join(first, ["i", "token", "salt"]).where("key <> b").select(F.col("key").alias("a"), "b").distinct())
    return similar_pairs(source, classes, pairs, PERCENT, width)


def _matrix(source: DataFrame, grouped: DataFrame, counts: np.ndarray, width: int):
    """(token, head, gid, n) for the prefix of every class, dealt by token; and the broadcast of the counts. Classes and groups go by 64-bit numbers here."""
    given = source.sparkSession.sparkContext.broadcast(np.minimum(counts, 0xFFFFFFFF).astype(np.uint32))

    def run(batches):
        seen = set()
        for batch in sliced(batches):
            keys, prefixes, size = [], [], 0
            for tokens in shingle_sets(raw(batch.column(1)), width):
                key = set_key(tokens)
                if len(tokens) and key not in seen:
                    seen.add(key)
                    keys.append(key)
                    prefixes.append(rare_first(tokens, given.value).astype(np.int64))
                    size += len(prefixes[-1])
                if size > 1 << 18:
                    yield pack(keys, prefixes)
                    keys, prefixes, size = [], [], 0
            if keys:
                yield pack(keys, prefixes)

    def pack(keys, prefixes):
        ends = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes)))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), lists], names=["key", "prefix"])

    prefixes = source.mapInArrow(giving_back(run), "key binary, prefix array<long>")
    classes = prefixes.join(grouped.select("key", "head", F.xxhash64("gid").alias("gid"), F.col("n").cast("int").alias("n")), "key").dropDuplicates(["key"])
    return classes.select(F.explode("prefix").alias("token"), "head", "gid", "n").repartition("token"), given


def _open_lists(entries: DataFrame) -> DataFrame:
    """(token, head, gid, n, size, weight, main) of the tokens whose classes belong to several groups.

    Tokens with the same classes become one, and `weight` is their number. `main` is the group of most of the classes.
    """
    mark = F.xxhash64("head")
    lists = entries.groupBy("token").agg(
        F.count(F.lit(1)).alias("size"), F.min("gid").alias("low"), F.max("gid").alias("high"), F.bit_xor(mark).alias("x"),
        F.sum(F.shiftrightunsigned(mark, 24)).alias("s"))
    once = lists.where("low <> high").groupBy("size", "x", "s").agg(F.min("token").alias("token"), F.count(F.lit(1)).alias("weight")).select("token", "size", "weight")
    rows = stage(entries.join(once, "token"))
    counts = rows.groupBy("token", "gid").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("token").agg(F.max(F.struct("c", "gid"))["gid"].alias("main"))
    return rows.join(main, "token")


def _cells(lists: DataFrame, weight) -> DataFrame:
    """(token, chunk, part, kind, head, gid, n) for each class of each cell of the lists.

    The classes of a list are dealt into chunks and streamed (kind 1) past those outside its main group, which are sent to every chunk
    and held (kind 0), in parts if they are large. So each pair of different groups meets, and rows grow with the list.
    """
    outside = F.col("gid") != F.col("main")
    held = lists.where(outside).groupBy("token").agg(F.ceil(F.sum(weight) / HELD).alias("parts"), F.ceil(F.least(F.first("size") / STREAMED, F.lit(MOST))).alias("chunks"))
    shaped = lists.join(held, "token")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own_chunk, own_part = F.pmod(F.xxhash64("head"), F.col("chunks")), F.pmod(F.xxhash64("head", F.lit(1)), F.col("parts"))
    place = lambda chunk, part, kind: F.struct(chunk.alias("chunk"), part.alias("part"), F.lit(kind).alias("kind"))
    streamed = F.transform(upto("parts"), lambda part: place(own_chunk, part, 1))
    kept = F.when(outside, F.transform(upto("chunks"), lambda chunk: place(chunk, own_part, 0))).otherwise(F.array().cast("array<struct<chunk:bigint,part:bigint,kind:int>>"))
    return shaped.select("token", "head", "gid", "n", F.explode(F.concat(streamed, kept)).alias("at")).select("token", "at.chunk", "at.part", "at.kind", "head", "gid", "n")


def _with_homes(cells: DataFrame, lists: DataFrame) -> DataFrame:
    """Cells with the `HOMES` longest lists of each class, which two classes share in the same order."""
    order = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("s"), "token"))), 1, HOMES)
    return cells.join(lists.groupBy("head").agg(order["token"].alias("homes")), "head")


class _Held:
    """The held classes of a cell, and which of them a streamed class has to be compared with."""

    def __init__(self, token: int):
        self.token, self.more = token, []
        self.heads, self.groups, self.sizes, self.homes = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, HOMES), np.int64)

    def add(self, heads, groups, sizes, homes, more):
        self.heads, self.groups = np.concatenate((self.heads, heads)), np.concatenate((self.groups, groups))
        self.sizes, self.homes = np.concatenate((self.sizes, sizes)), np.concatenate((self.homes, homes))
        self.more += more

    def partners(self, group: int, size: int, home: np.ndarray) -> np.ndarray:
        """Held classes of other groups and of a fitting size that do not meet the class in an earlier one of its homes."""
        ok = (self.groups != group) & (100 * np.minimum(self.sizes, size) >= PERCENT * np.maximum(self.sizes, size))
        at = np.flatnonzero(ok)
        place = np.flatnonzero(home == self.token)
        earlier = home[: place[0]] if len(place) else home
        earlier = earlier[earlier != _NONE]
        return at[~np.isin(self.homes[at], earlier).any(axis=1)] if len(earlier) else at


_NONE = np.iinfo(np.int64).min  # no home; no hash is treated as one


def _homes(column: pa.Array) -> np.ndarray:
    """Lists of at most `HOMES` tokens as a padded matrix."""
    out = np.full((len(column), HOMES), _NONE)
    for i, tokens in enumerate(column.to_pylist()):
        out[i, : len(tokens)] = tokens
    return out


def _stretches(batches):
    """(token, held classes, streamed classes as rows (head, group, size, homes, more)) of consecutive rows of one cell (token, chunk, part)."""
    cell = held = None
    for batch in batches:
        marks = [np.asarray(batch.column(i)) for i in range(4)]
        cuts = np.flatnonzero(np.any([np.diff(m) != 0 for m in marks], axis=0)) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
            if start == stop:
                continue
            at = tuple(int(m[start]) for m in marks[:3])
            if at != cell:
                cell, held = at, _Held(at[0])
            heads, groups, sizes = (np.asarray(batch.column(i))[start:stop] for i in (4, 5, 6))
            homes = _homes(batch.column(7).slice(start, stop - start))
            more = batch.column(8).slice(start, stop - start).to_pylist()
            if marks[3][start] == 0:
                held.add(heads, groups, sizes, homes, more)
            elif len(held.heads):
                yield cell, held, zip(heads.tolist(), groups.tolist(), sizes.tolist(), homes, more)


def _in_cells(cells: DataFrame, more: str) -> DataFrame:
    """Cells in their order, with what `_stretches` reads."""
    ordered = cells.select("token", "chunk", "part", "kind", "head", "gid", "n", "homes", more).repartition("token", "chunk", "part")
    return ordered.sortWithinPartitions("token", "chunk", "part", "kind")


def _opening(prepare, enough):
    """(token, head) of the classes with a partner for which `enough(held, index, size, prepare(more))` holds."""

    def run(batches):
        for (token, _, _), held, rows in _stretches(batches):
            found = set()
            for head, group, size, home, more in rows:
                mine = prepare(more)
                partners = [i for i in held.partners(group, size, home).tolist() if enough(held, i, size, mine)]
                if partners:
                    found.add(head)
                    found.update(held.heads[partners].tolist())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([token] * len(found), pa.int64()), pa.array(sorted(found), pa.int64())], names=["token", "head"])

    return run


def _weights(tokens: list[dict]) -> dict[int, int]:
    return {x["token"]: x["weight"] for x in tokens}


def _overlap_allows(held: _Held, i: int, size: int, mine: dict) -> bool:
    """Whether the shared prefix tokens leave room for a similar pair.

    Of the tokens up to the end of the prefix that ends first, all common ones are counted; after it
    that set has n - prefix = ceil(0.8 n) - 1 tokens left.
    """
    theirs, other = held.more[i], int(held.sizes[i])
    if not isinstance(theirs, dict):
        theirs = held.more[i] = _weights(theirs)
    small, large = (mine, theirs) if len(mine) < len(theirs) else (theirs, mine)
    common = sum(w for t, w in small.items() if t in large)
    return common + (4 * max(size, other) + 4) // 5 - 1 >= (4 * (size + other) + 8) // 9


def _meeting(lists: DataFrame) -> DataFrame:
    """(token, head): the classes that have a partner to be compared with in a list.

    First by groups, sizes and homes, which are narrow; then, for those that are left, by the number of tokens that a pair shares.
    """
    places = _with_homes(_cells(lists, F.lit(64)), lists).withColumn("more", F.lit(0))
    some = stage(_in_cells(places, "more").mapInArrow(giving_back(_opening(lambda more: None, lambda *_: True)), "token long, head long").distinct())
    left = lists.join(some, ["token", "head"], "left_semi")
    shared_tokens = lists.groupBy("head").agg(F.collect_list(F.struct("token", "weight")).alias("tokens"))
    places = _with_homes(_cells(left, F.col("n") * 4), lists).join(shared_tokens, "head")
    return stage(_in_cells(places, "tokens").mapInArrow(giving_back(_opening(_weights, _overlap_allows)), "token long, head long").distinct())


def _opened(source: DataFrame, classes: DataFrame, lists: DataFrame, every: DataFrame, width: int) -> DataFrame:
    """Links (a, b) between groups, by comparing the whole sets of the opened classes cell by cell."""

    def run(batches):
        cell, root = None, {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for at, held, rows in _stretches(batches):
            if at != cell:
                cell, root = at, {}
            left, right = [], []
            for head, group, size, home, packed in rows:
                whole = np.frombuffer(packed, np.uint64)
                for i in held.partners(group, size, home).tolist():
                    other = int(held.groups[i])
                    if find(group) == find(other):
                        continue
                    theirs = np.frombuffer(held.more[i], np.uint64)
                    both = shared(theirs, whole)
                    if 100 * both >= PERCENT * (len(theirs) + len(whole) - both):
                        root[find(group)] = find(other)
                        left.append(head)
                        right.append(int(held.heads[i]))
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    places = stage(_with_homes(_cells(lists, F.col("n") * 8), every).join(classes.select("head", "key"), "head"))
    sets, wanted = sets_of(source, classes, places.select("key").distinct(), width)
    found = stage(_in_cells(places.join(sets, "key"), "tokens").mapInArrow(giving_back(run), "a long, b long"))
    wanted.destroy()
    named = lambda side: classes.select(F.col("head").alias(side), F.col("key").alias(f"key_{side}"))
    return stage(found.join(named("a"), "a").join(named("b"), "b").select(F.col("key_a").alias("a"), F.col("key_b").alias("b")))


def _linked(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, n, key, component, first) for each row of `docs`: its set, its component's smallest set key and document id."""
    source = _texts(docs, id_col, text_col)
    profile = stage(_profile(source, width))
    members = profile.where("chunk is null").select("doc_id", "n", "key", "head", "smallest")
    classes = stage(members.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("head").alias("head"), F.first("smallest").alias("smallest")))
    counts = _bucket_counts(profile)

    stars = _leaders(source, classes, width)
    groups = stage(connected_components(stars))
    named = groups.withColumnsRenamed({"node": "key", "component": "gid"})
    grouped = stage(classes.join(named, "key", "left").select("key", "head", "n", F.coalesce("gid", "key").alias("gid")))
    entries, given = _matrix(source, grouped, counts, width)
    lists = stage(_open_lists(entries))
    given.destroy()
    meeting = _meeting(lists)
    links = stars
    if not meeting.isEmpty():
        links = links.unionByName(_opened(source, classes, lists.join(meeting, ["token", "head"], "left_semi"), lists, width))
    parts = stage(connected_components(links)).withColumnsRenamed({"node": "key"})

    rows = members.join(parts, "key", "left").withColumn("component", F.coalesce("component", "key"))
    firsts = rows.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("first"))
    out = rows.select("doc_id", "n", "key", "component").join(firsts, "component", "left")
    return out.select("doc_id", "n", "key", "component", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("first")).alias("first"))


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_key) for each row of `docs`; `set_key` is the digest of its shingle set."""
    return _linked(docs, id_col, text_col, width).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("first").alias("component_id"), F.lower(F.hex("key")).alias("set_key"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row of `docs` for each component: one with its smallest document id.

    Of rows with that id in one component the one with the smallest set key and row hash stays; different texts under one id that are not
    linked go by their own components. A component without any id keeps one row. A document without words is its own
    component, and stays once for each id. No column name is reserved.
    """
    linked = stage(_linked(docs, id_col, text_col, width))
    several = linked.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id")
    # a row whose id occurs once is named by its id alone, so its text is not looked at again
    away = stage(linked.where("doc_id <> first").select("doc_id").unionByName(several).distinct())
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    plain = packed.where("doc_id is not null").join(away, "doc_id", "left_anti").select("row.*")
    special = packed.where("doc_id is null").unionByName(packed.join(several, "doc_id", "left_semi").select("row", "doc_id", "text"))
    if special.isEmpty():
        return plain
    stay = linked.where(F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("component", "doc_id").agg(F.min("key").alias("key"))
    key = F.arrow_udf(lambda texts: pa.array([set_key(s) for s in shingle_sets(raw(texts), width)], pa.binary()), "binary")
    marked = special.select("row", "doc_id", key("text").alias("key"), F.xxhash64("row").alias("order"))
    ids = [F.col("doc_id").eqNullSafe(F.col("_id")), F.col("key") == F.col("_key")]
    kept = marked.join(stay.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")), ids, "left_semi")
    return plain.unionByName(kept.groupBy("doc_id", "key").agg(F.min_by("row", "order").alias("row")).select("row.*"))
