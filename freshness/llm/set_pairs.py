"""Exact comparison of pairs of shingle sets that are spread over a corpus.

Sets are identified by the digest of their tokens. Only the sets that some pair asks for leave the documents (a Bloom filter of bounded size
holds them back before the shuffle, a join on the digest removes its false positives); they are shuffled once by
digest and once to the cell in which they are compared. A cell is one hub and a part of its partners; it holds the hub's
set and streams the others past it, so hubs with very many partners are split and nothing piles up in memory.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from freshness.llm.bloom import bloom_table, may_contain
from freshness.llm.text import distinct, hashed, raw, sliced, window_hashes
from freshness.session import stage

FLUSH = 4 << 20  # bytes of sets in one Arrow batch
PART = 1 << 20  # tokens of a hub's partners that one cell compares


def giving_back(run):
    """The task function `run`, after which its worker returns what it has freed to the system; a worker lives for many tasks."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return task


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """For each text, sorted distinct 64-bit hashes of its lower-cased runs of `width` words; of all its words if they are fewer."""
    for words, windows in hashed([t.lower() for t in texts], width):
        yield distinct(windows if len(words) >= width or not len(words) else window_hashes(words, len(words)))


def set_key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def key_head(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def shared(hub: np.ndarray, other: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    at = np.searchsorted(hub, other)
    at[at == len(hub)] = 0
    return int((hub[at] == other).sum())


def _wanted_sets(source: DataFrame, width: int, wanted) -> DataFrame:
    """(key, tokens) of the documents whose key may be wanted; each key once a task."""

    def pack(keys, sets):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["key", "tokens"])

    def run(batches):
        table, seen = wanted.value, set()
        for batch in sliced(batches):
            keys, sets, size = [], [], 0
            for tokens in shingle_sets(raw(batch.column(1)), width):
                key = set_key(tokens)
                if len(tokens) and key not in seen and may_contain(table, np.array([key_head(key)]))[0]:
                    seen.add(key)
                    keys.append(key)
                    sets.append(tokens.tobytes())
                    size += len(sets[-1])
                if size > FLUSH:
                    yield pack(keys, sets)
                    keys, sets, size = [], [], 0
            if keys:
                yield pack(keys, sets)

    return source.mapInArrow(giving_back(run), "key binary, tokens binary")


def _against_hub(percent: int):
    """Pairs (a, b) with 100 * intersection >= percent * union, over rows (b, part, kind, a, tokens) sorted by cell with the hub first."""

    def run(batches):
        hub = owner = None
        for batch in batches:
            hubs, kinds, partners, sets = (batch.column(i) for i in (0, 2, 3, 4))
            left, right = [], []
            for i in range(len(batch)):
                tokens = np.frombuffer(sets[i].as_buffer(), np.uint64)
                if kinds[i].as_py() == 0:
                    hub, owner = tokens.copy(), hubs[i].as_py()
                    continue
                if hubs[i].as_py() != owner:
                    raise ValueError("a cell without its hub")
                if 100 * min(len(tokens), len(hub)) >= percent * max(len(tokens), len(hub)):
                    both = shared(hub, tokens)
                    if 100 * both >= percent * (len(hub) + len(tokens) - both):
                        left.append(partners[i].as_py())
                        right.append(owner)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    return run


def sets_of(source: DataFrame, classes: DataFrame, keys: DataFrame, width: int):
    """(key, tokens) of the wanted keys, which are distinct, from the documents; and the Bloom filter's broadcast, to destroy after use."""
    needed = stage(classes.select("key", "head").join(keys, "key", "left_semi"))
    wanted = source.sparkSession.sparkContext.broadcast(bloom_table(needed, "head", needed.count()))
    return _wanted_sets(source, width, wanted).join(needed.select("key"), "key", "left_semi").dropDuplicates(["key"]), wanted


def similar_pairs(source: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int, width: int) -> DataFrame:
    """Those of the pairs (a, b) of set keys with 100 * intersection >= percent * union, staged.

    `source` is (doc_id, text), `classes` (key, head, n); `b` is the hub of its pairs. `pairs` is a staged table without repetitions.
    """
    spark = source.sparkSession
    sized = pairs.join(classes.select(F.col("key").alias("a"), "n"), "a")
    hubs = sized.groupBy("b").agg(F.ceil(F.sum("n") / PART).alias("parts"))
    hubs = stage(hubs)
    routes = pairs.join(hubs, "b").select(F.col("a").alias("key"), "b", F.pmod(F.xxhash64("a"), "parts").alias("part"), F.lit(1).alias("kind"), "a")
    own = hubs.select(F.col("b").alias("key"), "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"),
                      F.lit(None).cast("binary").alias("a"))
    routes = stage(routes.unionByName(own))
    sets, wanted = sets_of(source, classes, routes.select("key").distinct(), width)
    cells = sets.join(routes, "key").select("b", "part", "kind", "a", "tokens").repartition("b", "part").sortWithinPartitions("b", "part", "kind")
    found = stage(cells.mapInArrow(giving_back(_against_hub(percent)), "a binary, b binary"))
    wanted.destroy()
    return found
