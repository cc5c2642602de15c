"""Byte-level helpers shared by the text operators.

Texts are handled as UTF-8 bytes: `bytes.split()` splits at exactly the six
characters U+0009..U+000D and U+0020, and `bytes.lower()` changes A-Z only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F


def raw(column: pa.Array) -> list[bytes]:
    """Values of a string column as UTF-8 bytes; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [v or b"" for v in column.cast(kind).to_pylist()]


def blocks(values: list, size_of, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive (start, end) ranges whose sizes add up to about `limit`, one value at least."""
    start = total = 0
    for i, v in enumerate(values):
        n = size_of(v)
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(values):
        yield start, len(values)


def sliced(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into runs of rows whose values in a string column take about `limit` bytes, one row at least.

    A batch may hold very many long texts; what a task makes of them then exists for one run at a time.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for start, stop in blocks(sizes, int, limit):
            yield batch.slice(start, stop - start)


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a fixed permutation)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_TABLE = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=8).digest() for i in range(256)), np.uint64)
_INSIDE = np.array([i not in (9, 10, 11, 12, 13, 32) for i in range(256)])
_BASE = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1
SLAB = 1 << 19  # bytes hashed at once
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `n` powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, 2 * len(_powers[0]) if i == 0 else len(_powers[0])), base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def _slab_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unmixed hashes, starts, ends) of the words in a stretch of bytes.

    A word's hash is a polynomial in its bytes, so all words come from one prefix sum.
    """
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _INSIDE[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    power, inverse = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * power[:-1], out=sums[1:])
    return (sums[ends] - sums[starts]) * inverse[starts], starts, ends


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of `text.split()`, in order; equal words have equal hashes.

    A word that a slab cuts is put together from its parts, so memory does not grow with the length of a word.
    """
    found: list[np.ndarray] = []
    open_size = 0  # bytes so far of a word that reaches the end of the last slab
    for at in range(0, len(text), SLAB):
        size = min(SLAB, len(text) - at)
        hashes, starts, ends = _slab_hashes(np.frombuffer(text, np.uint8, size, at))
        if open_size and len(starts) and starts[0] == 0:
            found[-1][-1] = np.uint64((int(found[-1][-1]) + pow(_BASE, open_size, 1 << 64) * int(hashes[0])) & _ALL)
            open_size = open_size + int(ends[0]) if ends[0] == size else 0
            hashes, starts, ends = hashes[1:], starts[1:], ends[1:]
        else:
            open_size = 0
        if len(hashes):
            found.append(hashes)
            open_size = int(ends[-1] - starts[-1]) if ends[-1] == size else 0
    return _mix(np.concatenate(found)) if found else np.empty(0, np.uint64)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every run of `width` word hashes, in order."""
    count = len(words) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(width):
        out = out * np.uint64(_BASE) + words[i : i + count]
    return _mix(out)


def hashed(texts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, hashes of runs of `width` words) for each text; short texts are hashed many at a time."""
    for start, stop in blocks(texts, len, SLAB):
        group = texts[start:stop]
        if len(group) == 1:
            words = word_hashes(group[0])
            yield words, window_hashes(words, width)
            continue
        raw_hashes, starts, _ = _slab_hashes(np.frombuffer(b"\n".join(group), np.uint8))
        words = _mix(raw_hashes)
        windows = window_hashes(words, width)
        begins = np.cumsum([0] + [len(t) + 1 for t in group])
        at = np.searchsorted(starts, begins).tolist()
        for i in range(len(group)):
            yield words[at[i] : at[i + 1]], windows[at[i] : max(at[i], at[i + 1] - width + 1)]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    ordered = np.sort(values)
    return ordered if len(ordered) < 2 else ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))]


def fold(key: str | Column, modulus: int) -> Column:
    """crc32 of an id's text modulo `modulus`; a null id counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % modulus


def with_fields(df: DataFrame, struct: Column, fields: list[str]) -> DataFrame:
    """`df` plus the fields of one struct column; a field replaces an input column of its name."""
    name = "__fields"
    while name in df.columns:
        name += "_"
    wide = df.withColumn(name, struct)
    return wide.withColumns({f: F.col(f"{name}.{f}") for f in fields}).drop(name)


def labelled_texts(
    docs: DataFrame, labels: DataFrame, label: str, keep: Column, max_rows: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, text, label) of at most `max_rows` labelled rows, chosen by a hash of the id.

    The bound is on the label rows that a model is fitted to; `max_rows` ids are
    joined to the documents by a broadcast of that size.
    """
    known = (
        labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__label"))
        .where(F.col("__id").isNotNull() & F.col("__label").isNotNull() & keep)
        .orderBy(F.xxhash64("__id"), "__id", "__label")
        .limit(max_rows)
    )
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(known), "__id").select(
        F.col("__id").alias("id"), "text", F.col("__label").alias("label")
    )
