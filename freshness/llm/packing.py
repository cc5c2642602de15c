"""Packing of token pieces into windows by best-fit decreasing.

A document's ids are cut into full windows from the start; what is left over is
one piece shorter than a window. Pieces are dealt into groups of bounded size, and each
group is packed by itself: longest piece first, each into the open window with the
least room that still holds it. A segment tree over the remaining capacities
finds that window in log(capacity) steps.

Edge cases: null counts as empty (its only id is the end id); repeated rows are
packed each; a document of exactly k windows has no shorter piece; an empty
table gives no pieces.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from freshness.llm.text import sliced
from freshness.session import stage

WINDOW = 4096
GROUP = 8192  # pieces of one packing group, on average
CACHE = 200_000  # parts of words a Python worker remembers, and as many other words
BLOCK = 4 << 20  # bytes of texts that are encoded and given out at once

# A line of words. Those whose encoding needs no normaliser: Latin-1 letters (one code point each, stable under NFC,
# lower-cased one by one), then marks that the splitting rule keeps together. No apostrophes, digits or `<|`. Then any other word.
_WORD = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]{1,47})([!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]{0,16})|(.*))$", re.MULTILINE)


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 itself, others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordEncoder:
    """Ids (little-endian unsigned 32 bit) of whitespace-separated words, for a tokenizer that drops white space.

    The tokenizer's splitting rule never matches white space and its normaliser works
    on characters around which blanks are starters, so the ids of a text are those of its words in order.
    Lower-cased letters and marks are remembered by themselves, as most new words are known ones in another case or with
    other marks. The tables of parts and of other words are cleared when they hold `limit` entries.
    """

    def __init__(self, path: str, limit: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.limit = limit
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}

    def __getitem__(self, word: bytes) -> bytes:
        return self.words([word])[0]

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word."""
        known, out = self.parts.get, []
        for letters, marks, other in _WORD.findall(b"\n".join(words).decode()) if words else []:
            if letters:
                letters = letters.lower()
                ids = known(letters) or self.part(letters)
                out.append(ids + (known(marks) or self.part(marks)) if marks else ids)
            else:
                out.append(self.others.get(other) or self.other(other))
        return out

    def part(self, text: str) -> bytes:
        """Ids of letters or marks; printable ASCII stands for itself in the vocabulary."""
        mapped = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
        return self._keep(self.parts, text, [t.id for t in self.tokenize(mapped)])

    def other(self, word: str) -> bytes:
        return self._keep(self.others, word, self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _keep(self, table: dict[str, bytes], text: str, ids: list[int]) -> bytes:
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(text) < 64:
            if len(table) >= self.limit:
                table.clear()
            table[text] = found
        return found

    def texts(self, column: pa.Array) -> list[bytes]:
        """Ids of each text of a string column; null counts as empty. A word is looked up once, however often the column has it."""
        words = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        ids = pa.array(self.words(distinct), pa.large_binary()).take(coded.indices)
        ends = np.concatenate(([0], np.cumsum(pc.binary_length(ids).to_numpy())))[words.offsets.to_numpy()].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                 window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): each document's ids plus `end_id`, cut into windows.

    `ids` is binary, little-endian unsigned 32 bit. A task holds the ids of about `BLOCK` bytes of texts at a time.
    """
    schema = docs.select(F.col(id_col).alias("doc_id")).schema.add("start", "long").add("length", "long").add("doc_tokens", "long").add("ids", "binary")
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        find = encoder(tokenizer_path)
        step = 4 * window
        for batch in sliced(batches, limit=BLOCK):
            rows = []
            for key, ids in zip(batch.column(0).to_pylist(), find.texts(batch.column(1))):
                ids += end
                total = len(ids) // 4
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    rows.append((key, at // 4, len(part) // 4, total, part))
            yield _pieces(rows, batch.column(0).type)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(cut, schema)


def _pieces(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    keys, starts, lengths, totals, ids = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, kind), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(totals, pa.int64()), pa.array(ids, pa.binary())],
        names=["doc_id", "start", "length", "doc_tokens", "ids"])


class Rooms:
    """Open windows by room left, with a segment tree that finds the least room of at least n."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)  # windows in the leaves below a node
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, which: int) -> None:
        self.open[room].append(which)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of the tightest open window, which is removed."""
        node = need + self.size
        if not self.tree[node]:
            while True:  # climb to the first subtree right of `need` that has windows
                if node == 1:
                    return None
                if node % 2 == 0 and self.tree[node + 1]:
                    node += 1
                    break
                node //= 2
            while node < self.size:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        room = node - self.size
        self._add(room, -1)
        return room, self.open[room].pop()

    def _add(self, room: int, change: int) -> None:
        node = room + self.size
        while node:
            self.tree[node] += change
            node //= 2


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each length; windows are numbered from 0. Equal lengths go in input order."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms, count = Rooms(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = rooms.take(need)
        if found is None:
            room, which = window, count
            count += 1
        else:
            room, which = found
        where[i], offset[i] = which, window - room
        if room > need:
            rooms.put(room - need, which)
    return where, offset


def pack(pieces: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """`pieces` plus sequence_id and offset; every column of `pieces` is carried along.

    `pieces` is written once under the checkpoint folder, so that texts are tokenized once.
    Pieces of a full window are sequences of their own and are not shuffled. The others are
    counted, and dealt to count / `group` groups by a hash of the row and its place, so a group
    stays near `group` pieces whatever the keys are. Only windows still open when a group ends
    are left partly empty. sequence_id is unique: group and window number, or minus the place of a
    full window.
    """
    pieces = stage(pieces)
    total = pieces.where(F.col("length") < window).count()
    groups = max(1, -(-total // group))
    place = F.monotonically_increasing_id()
    full = pieces.where(F.col("length") >= window).withColumns({"sequence_id": -1 - place, "offset": F.lit(0).cast("long")})
    rest = pieces.where(F.col("length") < window).withColumn("__group", F.pmod(F.xxhash64("doc_id", "start", place), F.lit(groups)))
    columns = pieces.columns

    def fit(key, table):
        table = table.select(columns).sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        where, offset = best_fit(table["length"].to_numpy(), window)
        return table.append_column("sequence_id", pa.array((key[0].as_py() << 32) + where)).append_column("offset", pa.array(offset))

    return rest.groupBy("__group").applyInArrow(fit, full.schema).unionByName(full)
