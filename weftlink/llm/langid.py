"""Language identification by string kernels.

The kernel of two texts counts the byte n-grams, of the blended lengths 2 to 4, that occur in both, over the root of
the product of how many occur in each. Landmark texts span a Nyström feature space, in which kernel ridge regression
is fitted for one language against the rest. A kernel of presences is an inner product of presence vectors, so
landmarks and coefficients fold into one matrix, and texts are scored by one matrix product for each batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm import common

#: n-grams of 2 and 3 bytes and of 4 bytes are hashed into this many places.
DIM = 1 << 15
LENGTHS = (2, 3, 4)
#: Labelled rows of each language that are learned from at most, and how many of those are landmarks.
SAMPLE = 400
LANDMARKS = 96
#: Rows whose presences are held at once.
ROWS = 256
RIDGE = 1e-2
UNKNOWN = "und"
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def presence(text: bytes, out: np.ndarray) -> None:
    """Sets out (DIM places) to 1 where one of text's n-grams falls. ASCII letters count as small ones, runs of other ASCII as one blank."""
    raw = np.frombuffer(text, np.uint8)
    lower = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    lower = np.where((lower >= 128) | ((lower >= 97) & (lower <= 122)), lower, np.uint8(32))
    lower = np.concatenate([[np.uint8(32)], lower, [np.uint8(32)]])
    blank = lower == 32
    lower = lower[~(blank & np.concatenate([[False], blank[:-1]]))].astype(np.uint32)
    gram = lower
    for n, mix in zip(LENGTHS, _MIX):
        if len(lower) < n:
            break
        gram = gram[:-1] * np.uint32(257) + lower[n - 1 :] if n < 4 else gram[:-1] * np.uint32(0x01000193) + lower[n - 1 :]
        out[(gram * mix) >> np.uint32(17)] = 1


def has_letters(text: str) -> bool:
    return any(map(str.isalpha, text))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most ROWS rows and about GROUP_BYTES of text."""
    for some in common.groups(batch):
        for at in range(0, some.num_rows, ROWS):
            yield some.slice(at, ROWS)


def learn_rows(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, bits) of at most about `sample` labelled rows of each language, drawn by a hash of doc_id; bits: packed presences of the whole text."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held_out())
    counts = known.groupBy("lang").count()
    drawn = (
        known.select("doc_id", "text", "lang")
        .join(F.broadcast(counts), "lang")  # a row for each language
        .where(common.rank_hash() < F.lit(float(sample)) / F.col("count"))
        .select("lang", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch):
                bits = np.zeros((some.num_rows, DIM), np.uint8)
                for row, text in zip(bits, common.as_bytes(some.column(1))):
                    presence(text, row)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], names=["lang", "bits"])

    return drawn.mapInArrow(run, "lang string, bits binary")


class KernelModel:
    """Scores are x / |x| @ weights + bias: kernel values against the landmarks, folded with the coefficients."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, langs: list[str], scale: float):
        self.weights, self.bias, self.langs, self.scale = weights, bias, langs, scale

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float32)
        return (x @ self.weights) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)) + self.bias


def fit(langs: list[str], bits: list[bytes], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel | None:
    """One-versus-rest kernel ridge regression on Nyström features; None without labelled rows."""
    if not langs:
        return None
    order = sorted(range(len(langs)), key=lambda i: (langs[i], bits[i]))
    names = sorted(set(langs))
    y = np.array([names.index(langs[i]) for i in order])
    x = np.stack([np.unpackbits(np.frombuffer(bits[i], np.uint8)) for i in order]).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    picks = np.random.default_rng(0).permutation(len(y))
    marks = np.sort(np.concatenate([picks[y[picks] == k][: max(1, landmarks // len(names))] for k in range(len(names))]))
    base = x[marks]
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = (x @ base.T).astype(np.float64) @ root
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    share = 1 / np.maximum(np.bincount(y, minlength=len(names)), 1)[y]
    share = share / share.sum()
    bias = share @ target
    middle = share @ z
    c = (z - middle) * share[:, None]
    alpha = np.linalg.solve(c.T @ (z - middle) + ridge / len(y) * np.eye(z.shape[1]), c.T @ (target - bias))
    weights = base.T.astype(np.float64) @ (root @ alpha)
    return KernelModel(weights.astype(np.float32), (bias - middle @ alpha).astype(np.float32), names, 4.0)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs (doc_id, text, lang).

    Learns from at most about `sample` rows of a language, from the whole text of each; every whole text is scored. Of
    languages with equal scores the first by name is taken. A null doc_id is not held out, and not learned from. A null text, or one without letters, is `und` with score 0; so is every text if no row has a label. lang is read only to learn, source
    and other columns never. Repeated rows are scored as often as they occur; an empty table gives no rows.
    """
    rows = learn_rows(docs, sample).collect()
    model = fit([r.lang for r in rows], [bytes(r.bits) for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch):
                texts = some.column(1).to_pylist()
                told = [bool(model) and t is not None and has_letters(t) for t in texts]
                x = np.zeros((len(texts), DIM), np.uint8)
                for row, text, ok in zip(x, texts, told):
                    if ok:
                        presence(text.encode(), row)
                best, chance = np.zeros(len(texts), int), np.zeros(len(texts))
                if model:
                    f = model.scores(x).astype(np.float64) * model.scale
                    e = np.exp(f - f.max(1, keepdims=True))
                    best, chance = f.argmax(1), (e / e.sum(1, keepdims=True)).max(1)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(2), pa.array([model.langs[b] if ok else UNKNOWN for b, ok in zip(best, told)], pa.string()), pa.array([float(c) if ok else 0.0 for c, ok in zip(chance, told)], pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    return docs.select("doc_id", "text", F.coalesce(common.held_out(), F.lit(False)).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
