"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes counts of hashed byte trigrams and of a few shape terms, weighted by
inverse document frequency and projected to `RANK` latent dimensions found by a
singular value decomposition of the labelled texts. Every document is compared with
every labelled vector by exact blocked cosine products; the nearest vote with
their similarity as weight.

Edge cases: null and empty texts are scored like any text, by their shape terms; without labels every
score is 0.5; repeated labelled rows vote each; other columns are kept, and a
column named like a result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from freshness.llm.quality_rules import measure_all
from freshness.llm.text import labelled_texts, raw, with_fields

DIMENSIONS = 4096  # hashed trigrams, without the shape terms
RANK = 64
NEIGHBOURS = 15
MAX_LABELLED = 6000  # label rows that vectors are made of: their size is fixed, whatever the input
SHAPE_WEIGHT = 2.0
BLOCK = 256  # documents compared at once
SHAPES = 9  # shape terms, each in `BINS` bins
BINS = 12


def _bin(value: float, scale: float) -> int:
    return min(BINS - 1, int(value * scale))


def shape_terms(counts: tuple[int, ...]) -> list[int]:
    """One bin for each of a few ratios: length, word length, symbols, marks, capitals, digits, repeats, distinct words, equal lines."""
    words, chars, symbols, dup_lines, repeats, lines, upper, letters, marks, digits, distinct = counts
    w = max(1, words)
    bins = (
        _bin(np.log2(1 + words), 1), _bin(chars / w, 1), _bin(symbols / w, 12), _bin(marks / w, 12), _bin(upper / max(1, letters), 12),
        _bin(digits / max(1, chars), 24), _bin(repeats / w, 12), _bin(distinct / w, 12), _bin(dup_lines / max(1, lines), 12),
    )
    return [i * BINS + b for i, b in enumerate(bins)]


def term_vectors(texts: list[bytes]) -> np.ndarray:
    """A row for each text: dampened counts of hashed byte trigrams, then the shape terms. 16-bit floats."""
    out = np.zeros((len(texts), DIMENSIONS + SHAPES * BINS), np.float32)
    for row, text, counts in zip(out, texts, measure_all(texts)):
        if len(text) >= 3:
            found = np.zeros(DIMENSIONS, np.int64)
            for at in range(0, len(text) - 2, 1 << 18):  # a long text takes no more memory than a short one
                piece = np.frombuffer(text, np.uint8, min((1 << 18) + 2, len(text) - at), at).astype(np.uint32)
                code = (piece[:-2] << np.uint32(16)) | (piece[1:-1] << np.uint32(8)) | piece[2:]
                found += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMENSIONS)
            row[:DIMENSIONS] = _DAMPED[np.minimum(found, len(_DAMPED) - 1)]
            row /= np.sqrt(row @ row)
        row[[DIMENSIONS + s for s in shape_terms(counts)]] = SHAPE_WEIGHT / 3
    return out.astype(np.float16)


_DAMPED = np.log1p(np.arange(1 << 16)).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray  # inverse document frequency of each term
    axes: np.ndarray  # terms x rank
    vectors: np.ndarray  # rank x labelled, each of length 1
    labels: np.ndarray

    def project(self, terms: np.ndarray) -> np.ndarray:
        latent = (terms * self.weights) @ self.axes
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

    def score(self, terms: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Similarity-weighted share of label 1 among the k nearest labelled vectors of each row."""
        if not len(self.labels):
            return np.full(len(terms), 0.5)
        cosines = self.project(terms) @ self.vectors
        k = min(k, len(self.labels))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, near, axis=1).astype(np.float64), 1e-6) ** 8
        votes = self.labels[near]
        return (weight * votes).sum(axis=1) / weight.sum(axis=1)


def fit(terms: np.ndarray, labels: np.ndarray, rank: int = RANK, seed: int = 7) -> Model:
    """Latent axes by a randomised singular value decomposition (a few power steps) of the labelled rows. Weights `terms` in place."""
    n, width = terms.shape
    if not n:
        return Model(np.ones(width, np.float32), np.zeros((width, 1), np.float32), np.zeros((1, 0), np.float32), labels)
    df = (terms > 0).sum(axis=0)
    weights = np.log((1 + n) / (1 + df)).astype(np.float32) + 1
    rank = min(rank, n, width)
    x = terms
    x *= weights  # in place: the sample's matrix is the largest thing that the driver holds
    q = np.random.default_rng(seed).standard_normal((width, rank + min(16, width - rank))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    axes = (q @ vt[:rank].T).astype(np.float32)
    model = Model(weights, axes, np.zeros((rank, 0), np.float32), labels.astype(np.float64))
    latent = x @ axes
    model.vectors = np.ascontiguousarray((latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)).T)
    return model


def _terms_of(texts: pa.Array) -> pa.Array:
    values = raw(texts)
    return pa.array([row.tobytes() for at in range(0, len(values), BLOCK) for row in term_vectors(values[at : at + BLOCK])], pa.binary())


def fit_neighbours(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: Column | None = None, max_rows: int = MAX_LABELLED,
                   id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Vectors of at most `max_rows` labelled texts. Terms are computed by the executors; 8 kB a row reach the driver."""
    rows = labelled_texts(docs, labels, label, F.lit(True) if keep is None else keep, max_rows, id_col, text_col)
    table = rows.select("id", "label", F.arrow_udf(_terms_of, "binary")("text").alias("terms")).toArrow()
    table = table.sort_by([("id", "ascending"), ("label", "ascending"), ("terms", "ascending")])
    terms = np.zeros((table.num_rows, DIMENSIONS + SHAPES * BINS), np.float32)
    for i, packed in enumerate(table["terms"]):
        terms[i] = np.frombuffer(packed.as_buffer(), np.float16)
    known = np.array(table["label"].to_pylist(), np.float64)
    del table
    return fit(terms, known)


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """`docs` plus score and predicted. The model has a fixed size (labelled rows x rank) and is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: pa.Array) -> pa.Array:
        values = raw(texts)
        out = np.zeros(len(values))
        for at in range(0, len(values), BLOCK):
            out[at : at + BLOCK] = shared.value.score(term_vectors(values[at : at + BLOCK]).astype(np.float32))
        return pa.StructArray.from_arrays([pa.array(out), pa.array((out >= threshold).astype(np.int32))], names=["score", "predicted"])

    return with_fields(docs, F.arrow_udf(score, "score double, predicted int")(F.col(text_col).cast("string")), ["score", "predicted"])
