"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

Words of one length whose letters fall into groups in the same numbers make a block. One replaced, added or
removed letter moves at most one unit between two groups, so a block is paired only with itself and its few neighbours: blocks
of the same length, and of the next length. For two blocks the product of their letter-count matrices gives
all squared distances at once: a replacement has distance 2, an insertion 1. Those pairs are verified letter by letter.

The number of letter groups is chosen from the sizes of the blocks that it would make, so blocks stay small as
the vocabulary grows; it changes the cost and never the result. Blocks with very many words are cut by hash, and each two
pieces are compared.

Edge cases: null texts have no words; a null id counts as the empty text; rows with equal ids and texts count
each; an empty table has no words; the letters of a very long word are counted in doubles, which stay exact; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from freshness.llm.text import raw
from freshness.session import stage

LETTERS = "".join(map(chr, (*range(0x61, 0x7B), *range(0xC0, 0x100))))  # what a lower-cased run may hold
RUN = re.compile("[a-zÀ-ÿ]+")
SLAB = 1 << 20  # characters of a text whose runs are listed at once
HELD = 200_000  # distinct words that a task counts before it hands them on
LEVELS = (1, 2, 3, 4, 6, 8, 12, 16)  # numbers of letter groups to choose from
PIECE = 2048  # words of a block that are compared at once
LETTERS_HELD = 4 << 20  # letters of a block, likewise
CELL_PAIRS = 5000  # pairs that cost as much as opening two blocks
_AT = np.full(256, -1, np.int64)
_AT[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))


def runs_of(text: str) -> Counter:
    """Runs of letters with their counts; a long text is read in slabs that end between runs."""
    if len(text) <= SLAB:
        return Counter(RUN.findall(text))
    found: Counter = Counter()
    at = 0
    while at < len(text):
        end = min(at + SLAB, len(text))
        while end < len(text) and (run := RUN.match(text, end - 1)) and run.end() > end:
            end = run.end()
        found.update(RUN.findall(text, at, end))
        at = end
    return found


def misspell(run: str, prefix: int, every: int) -> str:
    """The run without one letter, if its checksum is divisible by `every`."""
    h = zlib.crc32(run.encode(), prefix)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 5, min_count: int = 3, every: int | None = 97) -> DataFrame:
    """(word, n) of all lower-cased runs of letters. With `every`, runs whose checksum with the id it divides lose a letter.

    Each task adds up before the shuffle and hands on what it holds whenever that is many words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in runs_of(text.lower().decode()).items():
                    if every:
                        word = misspell(word, prefix, every)
                    if len(word) >= min_chars:
                        counts[word] += n
                if len(counts) > HELD:
                    yield packed()
                    counts.clear()
        yield packed()

    rows = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _signature(word: str, groups: int) -> Column:
    """How many letters of a word fall into each group; the sum is its length."""
    size = F.length(word)
    return F.array(*[(size - F.length(F.translate(word, LETTERS[g::groups], ""))).cast("int") for g in range(groups)])


def _neighbours(groups: int) -> list[list[int]]:
    """Steps from a signature to those of words one edit away, each unordered pair once."""
    unit = np.eye(groups, dtype=int)
    steps = [np.zeros(groups, int), *unit, *[unit[i] - unit[j] for i in range(groups) for j in range(i + 1, groups)]]
    return [s.tolist() for s in steps]


def _choose_groups(words: DataFrame) -> int:
    """The level whose blocks are cheapest to compare: cells to open and pairs in them."""
    best = []
    for groups in LEVELS:
        sizes = words.groupBy(_signature("word", groups).alias("s")).agg(F.count(F.lit(1)).cast("double").alias("size"))
        best.append(sizes.agg(F.lit(groups).alias("groups"), F.count(F.lit(1)).alias("blocks"), F.sum(F.col("size") * F.col("size")).alias("pairs")))
    table = best[0]
    for other in best[1:]:
        table = table.unionAll(other)
    cost = {r.groups: (1 + r.groups * (r.groups + 1) // 2) * (r.blocks * CELL_PAIRS + (r.pairs or 0)) for r in table.collect()}
    return min(LEVELS, key=cost.get)


def _matrix(codes: np.ndarray) -> np.ndarray:
    """Letter counts of equally long words given as a matrix of codes; exact in the chosen type."""
    n, size = codes.shape
    at = _AT[codes] + np.arange(n)[:, None] * len(LETTERS)
    counts = np.bincount(at.ravel(), minlength=n * len(LETTERS)).reshape(n, len(LETTERS))
    return counts.astype(np.float32 if size < 2048 else np.float64)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether row i of `a` is one replacement, or one insertion, from row i of `b`, which is as long or one longer."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    size = a.shape[1]
    front = np.cumprod(a == b[:, :size], axis=1).sum(axis=1)
    back = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= size


def near_in_blocks(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of words one edit apart between two blocks of codes; `same`: the block with itself, each pair once."""
    if not len(a) or not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x, y = _matrix(a), _matrix(b)
    wanted = 2 if a.shape[1] == b.shape[1] else 1  # adjacent lengths differ by an odd distance, equal ones by an even
    distance = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    i, j = np.nonzero(distance == wanted)
    if same:
        i, j = i[i < j], j[i < j]
    step = max(1, LETTERS_HELD // b.shape[1])
    keep = [one_edit(a[i[k : k + step]], b[j[k : k + step]]) for k in range(0, len(i), step)]
    ok = np.concatenate(keep) if keep else np.empty(0, bool)
    return i[ok], j[ok]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs (a, n_a, b, n_b) of the cells of a batch; a cell is two blocks of words joined without separators."""

    def block(text: str, counts: np.ndarray) -> np.ndarray:
        return np.frombuffer(text.encode("latin-1"), np.uint8).reshape(len(counts), -1)

    for batch in batches:
        columns = [batch.column(i) for i in range(5)]
        for row in range(len(batch)):
            ta, tb = columns[0][row].as_py(), columns[2][row].as_py()
            na, nb = (np.asarray(columns[k][row].values) for k in (1, 3))
            a, b = block(ta, na), block(tb, nb)
            i, j = near_in_blocks(a, b, columns[4][row].as_py())
            if len(i):
                la, lb = a.shape[1], b.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ta[k * la : k * la + la] for k in i.tolist()]), pa.array(na[i]), pa.array([tb[k * lb : k * lb + lb] for k in j.tolist()]), pa.array(nb[j])],
                    names=["a", "n_a", "b", "n_b"])


def near_words(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each unordered pair of distinct words one edit apart, once. `words` is (word, n), a staged table."""
    groups = _choose_groups(words)
    signed = words.withColumn("sig", _signature("word", groups))
    sizes = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.first(F.length("word")).alias("length"))
    # a piece holds about PIECE words, and about LETTERS_HELD letters
    pieces = F.ceil(F.col("size") * F.greatest(F.lit(1.0 / PIECE), F.col("length") / F.lit(float(LETTERS_HELD))))
    large = sizes.select("sig", pieces.alias("pieces")).where("pieces > 1")
    dealt = signed.join(large, "sig", "left").withColumn("piece", F.pmod(F.xxhash64("word"), F.coalesce("pieces", F.lit(1))))
    blocks = dealt.groupBy("sig", "piece").agg(F.collect_list(F.struct("word", "n")).alias("held"))
    blocks = stage(blocks.select("sig", "piece", F.array_join("held.word", "").alias("text"), F.col("held.n").alias("counts")))
    steps = F.array(*[F.array(*[F.lit(x) for x in s]) for s in _neighbours(groups)])
    sent = blocks.select("piece", F.col("text").alias("ta"), F.col("counts").alias("na"), F.col("sig").alias("home"), F.explode(steps).alias("step"))
    sent = sent.select("piece", "ta", "na", "home", F.zip_with("home", "step", lambda x, y: x + y).alias("sig")).where("array_min(sig) >= 0")
    met = sent.join(blocks.select("sig", F.col("piece").alias("other"), F.col("text").alias("tb"), F.col("counts").alias("nb")), "sig")
    met = met.where("home <> sig or piece <= other").select("ta", "na", "tb", "nb", ((F.col("home") == F.col("sig")) & (F.col("piece") == F.col("other"))).alias("same"))
    return met.mapInArrow(_compare, "a string, n_a long, b string, n_b long")


def spelling_forms(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each row of (word, n).

    The form is the near word with the largest n (ties: the smallest word), if that is at least twice the word's own; the
    root is the end of the chain of forms. Each step of a chain doubles n, so chains are short, and each round halves them.
    """
    words = stage(words)
    pairs = stage(near_words(words))
    both = pairs.unionAll(pairs.select("b", "n_b", "a", "n_a"))
    best = both.groupBy("a").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("order"), F.col("b").alias("form"))).alias("best"))
    joined = words.join(best, words["word"] == best["a"], "left")
    form_n = -F.col("best.order")
    has = F.coalesce(form_n >= 2 * F.col("n"), F.lit(False))
    formed = stage(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.form")).alias("form"), F.when(has, form_n).alias("form_n")))
    chain = stage(formed.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stage(chain.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        chain = longer.drop("moved")
        if longer.where("moved").isEmpty():
            break
    return formed.join(chain, "word", "left").withColumn("root", F.coalesce("root", "word"))
