"""Language-model scores by prediction by partial matching over bytes, and a word unigram base.

A text is its lower-cased words joined by one blank, then an end symbol. The model is a trie of byte contexts
up to `ORDER` symbols, kept as one table for each order: a row for each (context, next symbol) with its count in the
training texts. The code length of a symbol starts at the longest context. A symbol seen there costs its
share; otherwise an escape (half a count of every distinct symbol, method D) is paid and the next
shorter context is asked, without the symbols that the longer one has seen. Below order 0 all 256 symbols
that remain are equally likely.

What a longer context has seen a shorter one has too, so the excluded symbols of an order are just those of
the next longer context: every code length follows from counts of a context and of its suffix, and the whole trie is
priced by equal joins between neighbouring orders. Tables grow with the corpus and stay distributed. Texts are
cut into blocks of a few megabytes. A block sends each of its grams and words once, in sorted lists by shard
(a hash of the gram or word); a shard answers with a list of prices or counts in the same order, so the keys
themselves never travel back.

Edge cases: null and empty texts are the end symbol alone; without training texts all
symbols are equally likely and the base has N = V = 0; repeated rows count each; an empty table gives an empty
result; other columns of the input are not carried.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from freshness.llm.text import _mix, raw
from freshness.session import stage

ORDER = 5
END = 0xFF  # no byte of a UTF-8 text: the end of a text, and what stands before its start
SYMBOLS = 256  # bytes 0..254 and the end symbol
BLOCK_BYTES = 8 << 20  # text of one block
PIECE, PIECE_LINES = 2 << 20, 60_000  # symbols and lines whose grams are sorted at once
SHARD_BYTES, MAX_SHARDS = 16 << 20, 4096  # text for which there is one shard


def symbols(words: list[bytes]) -> bytes:
    """The bytes that the model reads: words with one blank between them, then the end symbol."""
    return b" ".join(words) + bytes([END])


def gram_pieces(lines: list[bytes], order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, line numbers) for all symbols of all lines, some megabytes at a time.

    A code holds the `order` symbols before a symbol and the symbol itself, 8 bits each. A line is preceded by
    `order` end symbols; a long line is cut, and its parts keep what comes before them.
    """
    pad = bytes([END]) * order
    parts: list[bytes] = []
    owners: list[int] = []
    held = 0
    for i, line in enumerate(lines):
        for at in range(0, len(line), PIECE):
            part = (pad + line[:at])[-order:] + line[at : at + PIECE] if at < order else line[at - order : at + PIECE]
            if parts and (held + len(part) > PIECE or len(parts) >= PIECE_LINES):
                yield _codes(parts, owners, order)
                parts, owners, held = [], [], 0
            parts.append(part)
            owners.append(i)
            held += len(part)
    if parts:
        yield _codes(parts, owners, order)


def _codes(parts: list[bytes], owners: list[int], order: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(parts), np.uint8)
    codes = np.zeros(len(data) - order, np.uint64)
    for i in range(order + 1):
        codes = (codes << np.uint64(8)) | data[i : len(data) - order + i]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    keep = np.ones(len(data), bool)  # the first symbols of each part are context only
    starts = np.cumsum(sizes) - sizes
    for i in range(order):
        keep[starts + i] = False
    return codes[keep[order:]], np.repeat(np.array(owners), sizes - order)


def _distinct(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and how often each occurs, or the sums of their counts."""
    if counts is None:
        ordered = np.sort(codes)
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.empty(0, np.int64)
        return ordered[first], np.diff(np.append(first, len(ordered)))
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.empty(0, np.int64)
    return ordered[first], np.add.reduceat(counts[order], first) if len(first) else np.empty(0, np.int64)


def block_grams(lines: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    found = [_distinct(codes) for codes, _ in gram_pieces(lines, order)]
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return _distinct(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def gram_shards(grams: np.ndarray, shards: int) -> np.ndarray:
    return (_mix(grams) % np.uint64(shards)).astype(np.int64)


def by_shard(keys: np.ndarray, shards: int) -> list[np.ndarray]:
    """Positions by shard, ascending in each."""
    order = np.argsort(keys, kind="stable")
    return np.split(order, np.searchsorted(keys[order], np.arange(1, shards)))


def _pack(values: np.ndarray) -> bytes:
    """Ascending or small integers, deflated byte plane by byte plane."""
    return zlib.compress(np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    plane = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(plane.T).view(np.uint64).reshape(-1)


def word_shards(words: list[bytes], shards: int) -> list[list[bytes]]:
    """Distinct words by shard, sorted."""
    out: list[list[bytes]] = [[] for _ in range(shards)]
    for w in sorted(words):
        out[zlib.crc32(w) % shards].append(w)
    return out


END_WORD = b"\xff"  # not UTF-8, so no word of a text
GATHERED = ["kind", "block", "doc_id", "text", "train", "shard", "keys", "counts"]
DOC, GRAMS, WORDS = 0, 1, 2


def _gather(docs: DataFrame, shards: int, order: int) -> DataFrame:
    """In one reading of the texts: every document with its block, and for each block the lists of its grams and words.

    Rows are of three kinds: documents (block, doc_id, text, train), grams (block, shard, sorted grams, training counts) and
    words. A block is a stretch of a task's input. N and V follow from the words' counts.
    """
    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    schema = f"kind int, block long, doc_id {kind_of_id}, text binary, train boolean, shard int, keys binary, counts binary"

    def run(batches):
        state = {"block": TaskContext.get().partitionId() << 24}
        ids, texts, trains, held, id_type = [], [], [], 0, None
        for batch in batches:
            id_type = batch.column(0).type
            for key, text, train in zip(batch.column(0).to_pylist(), raw(batch.column(1)), batch.column(2).to_pylist()):
                if texts and held + len(text) > BLOCK_BYTES:
                    yield from give(state["block"], ids, texts, trains, id_type)
                    state["block"] += 1
                    ids, texts, trains, held = [], [], [], 0
                ids.append(key)
                texts.append(text)
                trains.append(bool(train))
                held += len(text) + 64
        if texts:
            yield from give(state["block"], ids, texts, trains, id_type)

    def rows(size, id_type, **given):
        types = {"kind": pa.int32(), "block": pa.int64(), "doc_id": id_type, "text": pa.binary(), "train": pa.bool_(), "shard": pa.int32(),
                 "keys": pa.binary(), "counts": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(given[n], types[n]) if n in given else pa.nulls(size, types[n]) for n in GATHERED], names=GATHERED)

    def give(block, ids, texts, trains, id_type):
        size = len(ids)
        yield rows(size, id_type, kind=[DOC] * size, block=[block] * size, doc_id=ids, text=texts, train=trains)
        lines, counter, others = ([], []), Counter(), set()
        ends = 0
        for text, train in zip(texts, trains):
            words = text.lower().split()
            lines[train].append(symbols(words))
            if train:
                counter.update(words)
                ends += 1
            else:
                others.update(words)
        known, n = block_grams(lines[True], order)
        new, _ = block_grams(lines[False], order)
        grams, counts = _distinct(np.concatenate((known, new)), np.concatenate((n, np.zeros(len(new), np.int64))))
        parts = by_shard(gram_shards(grams, shards), shards)
        yield rows(shards, id_type, kind=[GRAMS] * shards, block=[block] * shards, shard=list(range(shards)),
                   keys=[_pack(np.diff(grams[p], prepend=np.uint64(0))) for p in parts], counts=[_pack(counts[p]) for p in parts])
        if ends:
            counter[END_WORD] += ends  # the end token counts like a word
        words = word_shards(list({*counter, *others}), shards)
        yield rows(shards, id_type, kind=[WORDS] * shards, block=[block] * shards, shard=list(range(shards)),
                   keys=[zlib.compress(b" ".join(w), 1) for w in words], counts=[_pack(np.array([counter[x] for x in w], np.int64)) for w in words])

    return docs.mapInArrow(run, schema)


def _gram_totals(gathered: DataFrame) -> DataFrame:
    """(gram, n, shard): training counts of every gram of any document."""

    def add(key, table):
        grams = np.concatenate([np.cumsum(_unpack(k), dtype=np.uint64) for k in table["keys"].to_pylist()])
        counts = np.concatenate([_unpack(c).astype(np.int64) for c in table["counts"].to_pylist()])
        grams, counts = _distinct(grams, counts)
        return pa.table({"gram": pa.array(grams.astype(np.int64)), "n": pa.array(counts), "shard": pa.array(np.full(len(grams), key[0].as_py(), np.int32))})

    return gathered.where(F.col("kind") == GRAMS).select("shard", "keys", "counts").groupBy("shard").applyInArrow(add, "gram long, n long, shard int")


def _word_counts(gathered: DataFrame) -> DataFrame:
    """(block, shard, payload, vocabulary, tokens): training counts of each block's words; the last two once a shard."""

    def add(key, table):
        lists = [zlib.decompress(k).split(b" ") for k in table["keys"].to_pylist()]
        total: Counter = Counter()
        for words, counts in zip(lists, table["counts"].to_pylist()):
            for word, n in zip(words, _unpack(counts).tolist()):
                if n:
                    total[word] += n
        payload = [_pack(np.array([total[w] for w in words if w], np.int64)) for words in lists]
        size = len(lists)
        return pa.table({
            "block": table["block"].cast(pa.int64()), "shard": pa.array([key[0].as_py()] * size, pa.int32()), "payload": pa.array(payload, pa.binary()),
            "vocabulary": pa.array([len(total)] + [0] * (size - 1), pa.int64()), "tokens": pa.array([sum(total.values())] + [0] * (size - 1), pa.int64())})

    words = gathered.where(F.col("kind") == WORDS).select("block", "shard", "keys", "counts")
    return words.groupBy("shard").applyInArrow(add, "block long, shard int, payload binary, vocabulary long, tokens long")


def _share(n: Column, total: Column) -> Column:
    """log10 probability of a symbol counted n times among `total`: half a count of each symbol goes to the escape."""
    return F.log10((2 * n - 1) / (2 * total))


def _escape(distinct: Column, total: Column) -> Column:
    return F.when(distinct > 0, F.log10(distinct / (2 * total))).otherwise(F.lit(0.0))


def trie_prices(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, price): log10 probability of the last symbol of each gram after those before it.

    `grams` has (gram, n). For a context s and its suffix r, the symbols seen after s are excluded from r: r keeps
    T(r) - sum of n(r, x) over them, and D(r) - D(s) distinct symbols. `below` is the price of a symbol once s was
    escaped from.
    """
    level = None
    for k in range(order + 1):
        mask = (1 << 8 * (k + 1)) - 1
        rows = grams.groupBy(F.col("gram").bitwiseAND(F.lit(mask).cast("long")).alias("gram")).agg(F.sum("n").alias("n"))
        context = Window.partitionBy(F.shiftrightunsigned("gram", 8))
        seen = F.col("n") > 0
        if level is None:
            rows = rows.withColumns({"T": F.sum("n").over(context), "D": F.sum(seen.cast("long")).over(context)})
            level = rows.withColumn("below", F.when(F.col("D") < SYMBOLS, -F.log10(F.lit(SYMBOLS) - F.col("D"))).otherwise(F.lit(0.0)))
            continue
        lower = level.select(F.col("gram").alias("suffix"), F.col("n").alias("n1"), F.col("T").alias("T1"), F.col("D").alias("D1"), F.col("below").alias("below1"))
        rows = rows.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(mask >> 8).cast("long"))).join(lower, "suffix")
        rows = rows.withColumns({"T": F.sum("n").over(context), "D": F.sum(seen.cast("long")).over(context),
                                 "R": F.sum(F.when(seen, F.col("n1")).otherwise(F.lit(0))).over(context)})
        left, distinct = F.col("T1") - F.col("R"), F.col("D1") - F.col("D")
        escape, found = _escape(distinct, left), _share(F.col("n1"), left)
        level = rows.withColumn("below", F.when(seen, F.lit(0.0)).when(F.col("n1") > 0, found).otherwise(escape + F.col("below1"))).select(
            "gram", "n", "T", "D", "below")
        if k < order:
            level = stage(level)
    escape = _escape(F.col("D"), F.col("T"))
    return level.select("gram", F.when(F.col("n") > 0, _share(F.col("n"), F.col("T"))).otherwise(escape + F.col("below")).alias("price"))


def _price_lists(gathered: DataFrame, prices: DataFrame) -> DataFrame:
    """(block, shard, payload): prices of each block's grams, 32-bit floats in the order of the grams."""

    def look_up(key, lists, table):
        gram, price = table["gram"].to_numpy().astype(np.uint64), table["price"].to_numpy().astype(np.float32)
        order = np.argsort(gram)
        gram, price = gram[order], price[order]
        out = [price[np.searchsorted(gram, np.cumsum(_unpack(k), dtype=np.uint64))].tobytes() for k in lists["keys"].to_pylist()]
        return pa.table({"block": lists["block"].cast(pa.int64()), "shard": pa.array([key[0].as_py()] * len(out), pa.int32()), "payload": pa.array(out, pa.binary())})

    lists = gathered.where(F.col("kind") == GRAMS).select("block", "shard", "keys")
    return lists.groupBy("shard").cogroup(prices.groupBy("shard")).applyInArrow(look_up, "block long, shard int, payload binary")


def score_documents(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) for each row of `docs`.

    `trains` says which rows are learned from. `score` is the log10 probability of the symbols of a text; `base_score` adds
    log10((c + 1) / (N + V + 1)) over its words and one end token.
    """
    if not 0 <= order <= 5:
        raise ValueError("a gram and a line number share 64 bits: order 5 at most")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), trains.alias("train"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = min(MAX_SHARDS, max(4, -(-size // SHARD_BYTES)))
    gathered = stage(_gather(source, shards, order))
    grams = stage(_gram_totals(gathered))
    shard_of = grams.select("gram", "shard")
    prices = trie_prices(grams.select("gram", "n"), order).join(shard_of, "gram")
    priced = _price_lists(gathered, prices)
    words = stage(_word_counts(gathered))
    totals = words.agg(F.coalesce(F.sum("vocabulary"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    vocabulary, tokens = int(totals[0]), int(totals[1])
    answers = priced.withColumn("kind", F.lit(GRAMS)).unionByName(words.select("block", "shard", "payload").withColumn("kind", F.lit(WORDS)))
    texts = gathered.where(F.col("kind") == DOC).select("block", "doc_id", "text", "train")
    result = docs.select(F.col(id_col).alias("doc_id")).schema
    for name, kind in (("train", "boolean"), ("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")):
        result = result.add(name, kind)

    def score(key, table, lists):
        texts = [t or b"" for t in table["text"].to_pylist()]
        words = [t.lower().split() for t in texts]
        payload = {(k, s): p for k, s, p in zip(lists["kind"].to_pylist(), lists["shard"].to_pylist(), lists["payload"].to_pylist())}
        count: dict[bytes, int] = {}
        trained = any(table["train"].to_pylist())
        for s, part in enumerate(word_shards(list(set().union(*words, [END_WORD] if trained else [])), shards)):
            count.update(zip(part, _unpack(payload[WORDS, s]).tolist()))
        base, known, number = _base_scores(words, count, tokens, vocabulary, ends)
        total = np.zeros(len(texts))
        lines = [symbols(w) for w in words]
        grams, _ = block_grams(lines, order)
        price = np.empty(len(grams))
        for s, at in enumerate(by_shard(gram_shards(grams, shards), shards)):
            price[at] = np.frombuffer(payload[GRAMS, s], np.float32)
        for codes, owner in gram_pieces(lines, order):
            first = int(owner[0])
            both = np.sort((codes << np.uint64(16)) | (owner - first).astype(np.uint64))
            codes, which = both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype(np.int64)
            start = np.concatenate(([True], codes[1:] != codes[:-1]))
            place = np.searchsorted(grams, codes[start])
            sums = np.bincount(which, weights=price[place][np.cumsum(start) - 1])
            total[first : first + len(sums)] += sums
        return pa.table({
            "doc_id": table["doc_id"], "train": table["train"], "n_tokens": pa.array(number), "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(len(texts), tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(total)})

    ends = source.where("train").count()
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, result)


def _base_scores(words: list[list[bytes]], count: dict[bytes, int], tokens: int, vocabulary: int, ends: int):
    """(sums of log10((c + 1) / (N + V + 1)), tokens with c > 0, tokens); each text has one end token, of count `ends`."""
    scale = np.log10(tokens + vocabulary + 1)
    base, known, number = np.zeros(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    for i, w in enumerate(words):
        c = np.fromiter(map(count.__getitem__, w), np.int64, len(w))
        number[i] = len(w) + 1
        known[i] = np.count_nonzero(c) + (ends > 0)
        base[i] = np.log10(c + 1.0).sum() + np.log10(ends + 1.0) - number[i] * scale
    return base, known, number
