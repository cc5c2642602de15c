"""Benchmark decontamination with one Aho-Corasick automaton per task.

`window_patterns` turns test questions and answers into windows of words,
`scan` finds every occurrence in every text in one pass.

Edge cases: a null or wordless text has no words, no hits and no spans; items
without words have no windows; repeated items count once per `item_id`; a null
`item_id` is reported as the empty string; an empty benchmark gives no hits.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from freshness.llm.text import raw

WIDTH = 10
MAX_PATTERN_BYTES = 24 << 20  # window bytes of one automaton; a larger benchmark is scanned in several parts

# bytes that end a word: every ASCII byte that is neither a digit nor a lower-case letter
_SEPARATORS = bytes(b for b in range(128) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A))
_NORMALISE = bytes.maketrans(bytes(range(65, 91)) + bytes(b for b in _SEPARATORS if not 65 <= b <= 90),
                             bytes(range(97, 123)) + b" " * (len(_SEPARATORS) - 26))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of digits, letters and non-ASCII characters."""
    return text.translate(_NORMALISE).split()


def window_patterns(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(pattern, n, items): each distinct window with the ids of the items that hold it."""

    def cut(batches):
        for batch in batches:
            ids, windows, sizes = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                words = words_of(text)
                n = min(width, len(words))
                found = {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
                ids += [key] * len(found)
                windows += [w.decode() for w in found]
                sizes += [n] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(windows, pa.string()), pa.array(sizes, pa.int32())],
                                             names=["item", "pattern", "n"])

    source = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    rows = source.mapInArrow(cut, "item string, pattern string, n int")
    return rows.groupBy("pattern", "n").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _automaton(patterns: list[tuple]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for i, (pattern, n) in enumerate(patterns):
        machine.add_word(f" {pattern} ", (i, n))
    machine.make_automaton()
    return machine


def _spans(machine, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
    """A mark per word inside an occurrence, and the patterns that occur.

    The texts are scanned as ` w1 w2 ... `, so a pattern begins and ends with
    a blank; the number of blanks up to its end is the number of its last word.
    """
    line = " " + b" ".join(words).decode() + " "
    hits = list(machine.iter(line))
    if not hits:
        return np.zeros(0, bool), set()
    blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)
    last = np.searchsorted(blanks, np.fromiter((end for end, _ in hits), np.int64, len(hits)))
    edges = np.zeros(len(words) + 1, np.int32)
    np.add.at(edges, last, -1)
    np.add.at(edges, last - np.fromiter((v[1] for _, v in hits), np.int64, len(hits)), 1)
    return np.cumsum(edges[:-1]) > 0, {v[0] for _, v in hits}


def original_spans(text: str, marks: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) characters in the original text of each run of marked words."""
    spans: list[list[int]] = []
    previous = False
    for word, marked in zip(WORD.finditer(_lower(text)), marks):
        if marked and previous:
            spans[-1][1] = word.end()
        elif marked:
            spans.append([word.start(), word.end()])
        previous = bool(marked)
    return [tuple(s) for s in spans]


def _lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<begin:int,end:int>>"


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH,
         max_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """`docs` plus one struct column `scan`: n_words, n_hit, items (sorted), spans.

    Spans are character offsets in the original text. The windows are written
    once; their bytes are counted before any of them leave the executors. Up to
    `max_bytes` of windows make one automaton, and a text is scanned once. A larger
    benchmark is dealt by hash into as many parts as needed; each part is scanned
    by a column of its own and the marks are united, so no window is left out.
    """
    from freshness.session import stage

    spark = docs.sparkSession
    windows = stage(window_patterns(benchmark, id_col, "text", width))
    total = windows.agg(F.sum(F.octet_length("pattern") + 32)).first()[0] or 0
    parts = max(1, -(-total // max_bytes))
    marks = None
    for part in range(parts):
        rows = windows.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part).collect()
        shared = spark.sparkContext.broadcast([(r.pattern, r.n, r.items) for r in rows])
        column = _scanner(shared)(F.col(text_col)) if marks is None else _merger(shared)(F.col(text_col), marks)
        marks = column
    return docs.withColumn("scan", _finish()(F.col(text_col), marks))


_KEEP: dict = {}  # the automaton of a broadcast, built once in each Python worker


def _machine(shared):
    if shared.id not in _KEEP:
        if len(_KEEP) >= 2:
            _KEEP.clear()
        patterns = shared.value
        _KEEP[shared.id] = (_automaton([(p, n) for p, n, _ in patterns]), [items for _, _, items in patterns])
    return _KEEP[shared.id]


class _Held:
    """A broadcast with the number it is known by, so that a worker builds its automaton once."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


MARKS = "n_words long, marks binary, items array<string>"


def _mark(shared, texts: pa.Array, before=None) -> pa.Array:
    machine, items_of = _machine(shared)
    counts, all_marks, all_items = [], [], []
    old = before.to_pylist() if before is not None else None
    for i, text in enumerate(raw(texts)):
        words = words_of(text)
        marks, found = _spans(machine, words) if words and items_of else (np.zeros(0, bool), set())
        items = {x for k in found for x in items_of[k]}
        if old is not None and old[i]["marks"]:
            earlier = np.unpackbits(np.frombuffer(old[i]["marks"], np.uint8), count=len(words)).astype(bool)
            marks = earlier | marks if len(marks) else earlier
        if old is not None:
            items |= set(old[i]["items"])
        counts.append(len(words))
        all_marks.append(np.packbits(marks).tobytes())
        all_items.append(sorted(items))
    return pa.StructArray.from_arrays(
        [pa.array(counts, pa.int64()), pa.array(all_marks, pa.binary()), pa.array(all_items, pa.list_(pa.string()))],
        names=["n_words", "marks", "items"])


def _scanner(broadcast):
    held = _Held(broadcast)
    return F.arrow_udf(lambda texts: _mark(held, texts), MARKS)


def _merger(broadcast):
    held = _Held(broadcast)
    return F.arrow_udf(lambda texts, before: _mark(held, texts, before), MARKS)


def _finish():
    def finish(texts: pa.Array, marked: pa.Array) -> pa.Array:
        hits, spans = [], []
        strings = texts.to_pylist()
        for text, n, packed in zip(strings, marked.field("n_words").to_pylist(), marked.field("marks").to_pylist()):
            if packed:
                marks = np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)
                hits.append(int(marks.sum()))
                spans.append([{"begin": b, "end": e} for b, e in original_spans(text, marks)])
            else:
                hits.append(0)
                spans.append([])
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        return pa.StructArray.from_arrays(
            [marked.field("n_words"), pa.array(hits, pa.int64()), marked.field("items"), pa.array(spans, kind)],
            names=["n_words", "n_hit", "items", "spans"])

    return F.arrow_udf(finish, RESULT)
