"""Quality by compression: two zstandard dictionaries, one built from good and one from bad
labelled text, compress every document; the normalised difference of the two sizes becomes
a calibrated probability.

Defined results: null and empty texts have difference 0 and get the calibrated score of
that value. Rows without a label, with a null label or a null id are never learned from.
Every input row gives one output row; only the id and text columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import as_bytes, map_rows, slices

LEVEL = 3
# Long texts are compressed in pieces so that the dictionary, not the text's own history,
# decides; every byte of the text takes part.
PIECE = 1024
# Segment length that dictionary training looks for.
SEGMENT = 64
# Bytes added to the two sizes, which draws the difference of very short texts towards 0.
SHRINK = 48


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    mean: float
    scale: float
    slope: float
    bias: float

    def scores(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        x = differences(texts, self.good, self.bad)
        z = (x - self.mean) / self.scale
        return x, 1.0 / (1.0 + np.exp(-np.clip(self.slope * z + self.bias, -60, 60)))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def differences(texts: list[bytes | None], good: bytes, bad: bytes) -> np.ndarray:
    """(size with the bad dictionary - size with the good one) / (their sum + SHRINK)."""
    by_good, by_bad = _compressor(good).compress, _compressor(bad).compress
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        if not text:
            continue
        a = b = 0
        for at in range(0, len(text), PIECE):
            piece = text[at:at + PIECE]
            a += len(by_good(piece))
            b += len(by_bad(piece))
        out[i] = (b - a) / (a + b + SHRINK)
    return out


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A dictionary of segments frequent over the pieces; raw text if there is too little to train on."""
    pieces = [t[at:at + PIECE] for t in texts for at in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(size, pieces, k=SEGMENT, d=8).as_bytes()
    except zstandard.ZstdError:
        return (b"\n".join(texts) + b"-" * 8)[:size]


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """Logistic fit of the label on the difference, by Newton steps with a light ridge."""
    mean, scale = float(x.mean()), float(x.std()) or 1.0
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -60, 60)))
        grad = z.T @ (p - y) + np.array([1e-3, 0]) * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, float(w[0]), float(w[1])


def fit_compression_model(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *,
                          sample_per_label: int = 3000, dictionary_bytes: int = 1 << 16) -> CompressionModel:
    """Fit on a bounded sample: of each label at most ``sample_per_label`` ids of ``labels``, those
    with the smallest hash, each with its whole text. Half of them make the dictionaries, the other
    half, unseen by these, calibrates. The bound is of the fit alone; scoring reads every text.

    The sample is chosen among labels and then looked up, so documents are scanned once and not moved.
    An id counts once, with the smallest of its texts, however often labels or documents repeat it.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(
        F.col(id_col), F.col(label_col).cast("int").alias("_label"), F.xxhash64(F.col(id_col).cast("string")).alias("_order")).distinct()
    chosen = [known.where(F.col("_label") == k).orderBy("_order").limit(sample_per_label) for k in (0, 1)]
    # At most twice sample_per_label rows.
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))
    found = documents.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("_text")).join(picked, id_col).groupBy(
        "_label", "_order", id_col).agg(F.min("_text").alias("_text")).collect()
    found.sort(key=lambda r: (r["_order"], r["_text"]))
    texts = {k: [r["_text"].encode() for r in found if r["_label"] == k] for k in (0, 1)}
    total = len(texts[0]) + len(texts[1])
    if not texts[0] or not texts[1]:  # nothing to tell apart: the share of good labels, or one half
        share = (len(texts[1]) + 1) / (total + 2)
        return CompressionModel(b"-" * 8, b"-" * 8, 0.0, 1.0, 0.0, float(np.log(share / (1 - share))))
    bad, good = (_dictionary(texts[k][::2], dictionary_bytes) for k in (0, 1))
    halves = {k: texts[k][1::2] or texts[k] for k in (0, 1)}
    x = differences(halves[0] + halves[1], good, bad)
    y = np.r_[np.zeros(len(halves[0])), np.ones(len(halves[1]))]
    return CompressionModel(good, bad, *_calibrated(x, y))


def score_quality(df: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text", *, accept: float = 0.7) -> DataFrame:
    """Map-only: id, size_difference, score and predicted (1 from ``accept`` on) of every row."""
    rows = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    id_type = rows.schema[0].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            x, p = model.scores(as_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x), pa.array(p)], [id_col, "size_difference", "score"])

    scored = map_rows(rows, run, f"`{id_col}` {id_type}, size_difference double, score double")
    return scored.withColumn("predicted", (F.col("score") >= accept).cast("int"))


def accepted(df: DataFrame, model: CompressionModel, text_col: str = "text", *, accept: float = 0.7) -> DataFrame:
    """The rows of ``df`` that score at least ``accept``, all columns as they are. Map-only."""
    schema = df.schema
    at = df.columns.index(text_col)

    def run(batches):
        for batch in slices(batches, column=at):
            _, p = model.scores(as_bytes(batch.column(at)))
            yield batch.filter(pa.array(p >= accept))

    return df.mapInArrow(run, schema)
