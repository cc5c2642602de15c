"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text up to `CHUNK` characters is encoded in one call. A longer one is encoded
in chunks that overlap. Two neighbouring encodings are spliced at a boundary
that both have and that is proven stable: no vocabulary piece holds the two
characters around it next to each other, so no merge of any encoding can cross
it, and what lies left and right of it is encoded alike whatever surrounds it.
If the overlap holds no such boundary it is doubled; if it comes to cover the
whole chunk, the chunk grows.

Edge cases: null counts as empty (0 bytes, 0 tokens); repeated rows are counted
each; other columns of the input are kept, and a column named like a result is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from freshness.llm.text import blocks, with_fields

CHUNK, OVERLAP = 32_768, 512  # characters
BATCH_CHARS = 2 << 20  # characters given to the tokenizer at once
META = "▁"  # how a blank looks inside a piece
PROBE = "A  ﬁ Å é Ａ\t\n x"


class Model:
    """A sentencepiece model with what is needed to prove a boundary stable."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [p for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) for p in [sp.id_to_piece(i)]]
        self.joined = {pair for piece in plain for pair in zip(piece, piece[1:])}
        # the proof is about the characters that the model merges: a model that rewrites texts first is given whole texts
        self.verbatim = sp.normalize(PROBE).replace(META, " ").removeprefix(" ") == PROBE

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)

    def with_offsets(self, text: str, base: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of text[base:end] and the position in `text` at which each starts.

        All bytes of one character start at that character. The blank that the
        model puts before a chunk starts with the chunk, left of any splice.
        """
        found = self.processor.encode(text[base:end], return_type="offset_mapping")
        return np.array(found["ids"], np.int64), np.array([o[0] for o in found["offsets"]], np.int64) + base

    def stable(self, left: str, right: str) -> bool:
        return (META if left == " " else left, META if right == " " else right) not in self.joined


@lru_cache(2)
def load(path: str) -> Model:
    return Model(path)


def splice(model: Model, text: str, left: np.ndarray, right: np.ndarray, base: int, end: int) -> int | None:
    """A stable position where both encodings begin a token, as near as possible to the middle of the overlap."""
    common = np.intersect1d(left, right)
    common = common[(common > base) & (common < end)]
    for position in common[np.argsort(np.abs(2 * common - base - end), kind="stable")]:
        if model.stable(text[position - 1], text[position]):
            return int(position)
    return None


def encode_long(model: Model, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[np.ndarray]:
    """The ids of `text` in parts; together they equal one call on the whole text."""
    if not model.verbatim or len(text) <= chunk:
        yield np.array(model.encode([text])[0], np.int64)
        return
    base, end, done = 0, chunk, 0  # the encoding at hand covers text[base:end]; what lies before `done` is given out
    ids, starts = model.with_offsets(text, base, end)
    while end < len(text):
        width, position, stop = overlap, None, min(len(text), end + chunk)
        while position is None and end - width > done:
            next_ids, next_starts = model.with_offsets(text, end - width, stop)
            position = splice(model, text, starts, next_starts, max(done, end - width), end)
            next_base, width = end - width, 2 * width
        if position is None:
            ids, starts = model.with_offsets(text, base, stop)
        else:
            yield ids[np.searchsorted(starts, done) if done else 0 : np.searchsorted(starts, position)]
            ids, starts, base, done = next_ids, next_starts, next_base, position
        end = stop
    yield ids[np.searchsorted(starts, done) if done else 0 :]


def token_counts(docs: DataFrame, model_path: str, text_col: str = "text", limit: int = 4096, chunk: int = CHUNK,
                 overlap: int = OVERLAP) -> DataFrame:
    """`docs` plus n_bytes, n_tokens and over_limit. `model_path` is read on the executors."""

    def count(texts: pa.Array) -> pa.Array:
        model = load(model_path)
        values = [t or "" for t in texts.to_pylist()]
        tokens = np.zeros(len(values), np.int64)
        for start, stop in blocks(values, len, BATCH_CHARS):
            short = [i for i in range(start, stop) if len(values[i]) <= chunk]
            tokens[short] = [len(ids) for ids in model.encode([values[i] for i in short])]
        for i, text in enumerate(values):
            if len(text) > chunk:
                tokens[i] = sum(len(part) for part in encode_long(model, text, chunk, overlap))
        sizes = pa.array([len(t.encode()) for t in values], pa.int64())
        return pa.StructArray.from_arrays([sizes, pa.array(tokens), pa.array(tokens > limit)], names=["n_bytes", "n_tokens", "over_limit"])

    udf = F.arrow_udf(count, "n_bytes long, n_tokens long, over_limit boolean")
    return with_fields(docs, udf(F.col(text_col)), ["n_bytes", "n_tokens", "over_limit"])
