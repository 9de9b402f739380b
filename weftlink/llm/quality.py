"""A classifier of text quality by compression.

One zstandard dictionary is trained on pieces of texts labelled good and one on pieces of texts labelled bad. How much
smaller a text becomes with the one than with the other, over its size, goes through a logistic curve that is fitted on
other labelled texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm import common

#: Labelled rows of each label that are learned from at most; half train the dictionaries.
SAMPLE = 2400
#: Pieces of one labelled text that are learned from at most, spread evenly over all of it.
SAMPLE_PIECES = 12
DICTIONARY_BYTES = 400_000
#: Texts are compressed in pieces of so many bytes, so that a long text leans on the dictionary as a short one does.
PIECE_BYTES = 1024
LEVEL = 3
THRESHOLD = 0.7


class CompressionModel:
    """good, bad: dictionaries; slope, offset: of the logistic curve."""

    def __init__(self, good: bytes, bad: bytes, slope: float = 0.0, offset: float = 0.0):
        self.good, self.bad, self.slope, self.offset = good, bad, slope, offset

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_both"}

    def difference(self, text: bytes) -> float:
        """(size with the bad dictionary - size with the good one) / bytes, over the text's pieces; 0 for an empty text."""
        if not text:
            return 0.0
        if "_both" not in self.__dict__:
            import zstandard as zstd

            options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
            self._both = [zstd.ZstdCompressor(level=LEVEL, dict_data=zstd.ZstdCompressionDict(d), **options) for d in (self.good, self.bad)]
        good, bad = self._both
        view = memoryview(text)
        total = 0
        for at in range(0, len(text), PIECE_BYTES):
            piece = view[at : at + PIECE_BYTES]
            total += len(bad.compress(piece)) - len(good.compress(piece))
        return total / len(text)

    def score(self, text: bytes) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.difference(text) + self.offset))))


def spread(text: bytes, most: int = SAMPLE_PIECES) -> list[bytes]:
    """All pieces of a text, or `most` of them at even distances, the first and the last included."""
    n = -(-len(text) // PIECE_BYTES)
    places = range(n) if n <= most else [k * (n - 1) // (most - 1) for k in range(most)]
    return [text[k * PIECE_BYTES : (k + 1) * PIECE_BYTES] for k in places]


def learn_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, float]:
    """(doc_id, text, quality) of at most about `sample` labelled rows of each label, drawn by a hash of doc_id; the share of label 1 among all.

    text: bytes, the text's pieces of PIECE_BYTES, or those that spread() takes of a longer one.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~common.held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("quality") == label, F.lit(sample / n)).otherwise(share)
    drawn = known.where(common.rank_hash() < share)
    # about 2 * sample ids: the size is bounded by the parameter
    rows = docs.select("doc_id", "text").where("text <> ''").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in common.groups(batch):
                pieces = [b"".join(spread(t)) for t in common.as_bytes(some.column(1))]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(pieces, pa.binary()), some.column(2)], names=["doc_id", "text", "quality"])

    schema = f"doc_id long, text binary, quality {labels.schema['quality'].dataType.simpleString()}"
    return rows.mapInArrow(run, schema), sizes.get(1, 0) / max(1, sum(sizes.values()))


def _curve(x: np.ndarray, y: np.ndarray, prior: float = 0.5) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits best by Newton's method with a slight ridge. prior: the share of label 1 among all."""
    scale = float(np.abs(x).mean()) or 1.0
    z = np.stack([x / scale, np.ones_like(x)], 1)
    weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum()))
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2), z.T @ (weight * (y - p)) - 1e-4 * b)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0] / scale), float(b[1])


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained on the texts' pieces; of too little text for that, the text itself."""
    import zstandard as zstd

    pieces = [p for t in texts for p in spread(t)]
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstd.ZstdError:
        return b"\n".join(pieces)[:DICTIONARY_BYTES] or b"\0" * 8


def fit(rows: list[tuple[int, bytes, int]], prior: float = 0.5) -> CompressionModel:
    """The model of labelled rows (doc_id, text, quality). With one label only, the curve is flat at that label's side."""
    rows = sorted({(i, bytes(t), q) for i, t, q in rows})
    of = {q: [t for _, t, label in rows if label == q] for q in (0, 1)}
    model = CompressionModel(dictionary(of[1][::2]), dictionary(of[0][::2]))
    rest = [(t, q) for q in (0, 1) for t in of[q][1::2]]
    y = np.array([label for _, label in rest])
    if len(set(y.tolist())) == 2:
        model.slope, model.offset = _curve(np.array([model.difference(t) for t, _ in rest]), y, prior)
    elif rows:
        model.offset = 2.0 if rows[0][2] else -2.0
    return model


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> CompressionModel:
    """The model of the labelled rows of docs. One task fits it on the sample, whose size is bounded; the driver gets the dictionaries."""
    rows, prior = learn_rows(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit([row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3)))], prior)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (model.good, model.bad, model.slope, model.offset)], names=["good", "bad", "slope", "offset"])

    made = rows.repartition(1).mapInArrow(run, "good binary, bad binary, slope double, offset double").first()
    if made is None:  # no rows, no task
        return fit([], prior)
    return CompressionModel(bytes(made["good"]), bytes(made["bad"]), made["slope"], made["offset"])


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that classify() predicts 1 for, with all their columns; decided row by row, without a shuffle."""
    model = learn(docs, labels, sample)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in common.groups(batch, at):
                yield some.filter(pa.array([model.score(t) >= threshold for t in common.as_bytes(some.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text).

    Learns from at most about `sample` rows of each label, of longer ones from SAMPLE_PIECES pieces; every whole text is
    scored. A null text counts as empty, and an empty text has the difference 0. A null doc_id is not held out, and has
    no label. Texts with one score are all predicted alike. Without labels every score is 0.5.
    Labels other than 0 and 1 are left out; of a document labelled twice the lower label counts. Repeated rows are
    scored as often as they occur; other columns are not read; an empty table gives no rows.
    """
    model = learn(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in common.groups(batch):
                scores = [model.score(t) for t in common.as_bytes(some.column(1))]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", F.coalesce(common.held_out(), F.lit(False)).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
