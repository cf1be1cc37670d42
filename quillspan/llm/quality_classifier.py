"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed statistics.  Each class has a mean and a covariance, shrunk towards
the pooled covariance and then towards a multiple of the identity (Friedman's two parameters); the score is a logistic
function of the difference of the two log densities, taken with Cholesky factors that are computed once.

Counts, sums and products of all labelled rows are added up where the rows are, a few hundred numbers for each task,
so nothing that grows with the corpus is sent to the driver and no label is left out.

Defined results: a null text counts as empty; an empty text has a vector (of zeros) and a score; labels that are null
or neither 0 nor 1 are ignored; an id with several labels counts with each; an id with several texts trains with each;
without labels of both classes every score is 0.5; other columns are ignored; rows are returned as often as they occur.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, fold, small

#: Classes of bytes: capitals, small letters, digits, blanks, line feeds, sentence ends, other ASCII marks, non-ASCII.
_CLASSES = np.full(256, 7)
_CLASSES[:128] = 6
_CLASSES[65:91], _CLASSES[97:123], _CLASSES[48:58] = 0, 1, 2
_CLASSES[[9, 11, 12, 13, 32]], _CLASSES[10], _CLASSES[[33, 46, 63]] = 3, 4, 5
_ONE_HOT = np.eye(8)[_CLASSES]
N_FEATURES = 15


def features(text: str | None) -> np.ndarray:
    """Transformed statistics of a whole text, N_FEATURES numbers."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text.encode(errors="replace"), np.uint8), minlength=256)
    n = int(counts.sum())
    share = counts @ _ONE_HOT / n
    words = text.split()
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    p = counts[counts > 0] / n
    n_words = max(len(words), 1)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False))) if len(words) > 1 else 1
    out[:8] = np.log(share + 0.002)
    out[8] = math.log1p(len(words))
    out[9] = math.log(len(text) / n_words + 0.1)
    out[10] = math.log(distinct / n_words + 0.01) + 0.3 * math.log1p(len(words) / 200)
    out[11] = math.log(pairs / max(len(words) - 1, 1) + 0.01)
    out[12] = math.log(1.02 - len(set(lines)) / max(len(lines), 1))
    out[13] = -float(p @ np.log2(p))
    out[14] = math.log(sum(map(_bare, words)) / n_words + 0.005)
    return out


def _bare(word: str) -> bool:
    """Whether a word begins or ends with a mark other than those of sentences."""
    a, z = word[0], word[-1]
    return not (a.isalnum() or a in "\"'([«¿¡") or not (z.isalnum() or z in ".,;:!?\"')]»…") or len(word) > 2 and not word[-2].isalnum() and not z.isalnum()


@dataclass(frozen=True)
class Discriminant:
    """mean[c], inverse Cholesky factor[c] and the constant of each class; warmth divides the difference of log densities."""

    mean: np.ndarray
    factor: np.ndarray
    constant: np.ndarray
    warmth: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        density = [self.constant[c] - 0.5 * np.square((x - self.mean[c]) @ self.factor[c].T).sum(1) for c in (0, 1)]
        z = (density[1] - density[0]) / self.warmth
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def discriminant(n: np.ndarray, total: np.ndarray, products: np.ndarray, pooled: float = 0.2, ridge: float = 0.02) -> Discriminant | None:
    """From each class's count, sum and sum of outer products; None unless both classes have rows."""
    if n.min() < 1:
        return None
    mean = total / n[:, None]
    scatter = products - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    together = scatter.sum(0) / n.sum()
    d = total.shape[1]
    factor, constant = [], []
    for c in (0, 1):
        s = (1 - pooled) * scatter[c] / n[c] + pooled * together
        s = (1 - ridge) * s + (ridge * np.trace(s) / d + 1e-6) * np.eye(d)
        low = np.linalg.cholesky(s)
        factor.append(np.linalg.inv(low))
        constant.append(math.log(n[c] / n.sum()) - np.log(np.diag(low)).sum())
    return Discriminant(mean, np.array(factor), np.array(constant), float(d))


def vectors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and x (array<double>), one pass over whole texts."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            x = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], [doc_id, "x"])

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, x array<double>")


def fit(labelled: DataFrame, **shrinkage) -> Discriminant | None:
    """``labelled``: x, label and weight (how many labels a row stands for).  Adds up moments within tasks, then over tasks."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = N_FEATURES
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(-1, d)
                y, w = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(float)
                for c in (0, 1):
                    z, own = x[y == c], w[y == c, None]
                    sums[c] += np.concatenate([[own.sum()], (z * own).sum(0), (z.T @ (z * own)).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], ["label", "sums"])

    parts = labelled.select("x", F.col("label").cast("int").alias("label"), "weight").mapInArrow(moments, "label int, sums array<double>")
    # element by element, so that tasks' sums meet in many small groups and one row for each comes back
    rows = parts.select("label", F.posexplode("sums")).groupBy("label", "pos").agg(F.sum("col").alias("v")).collect()
    sums = np.zeros((2, 1 + N_FEATURES + N_FEATURES**2))
    for r in rows:
        sums[r["label"], r["pos"]] = r["v"]
    d = N_FEATURES
    return discriminant(sums[:, 0], sums[:, 1 : d + 1], sums[:, d + 1 :].reshape(2, d, d), **shrinkage)


def classify(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    ``held_out`` is a condition on ``doc_id``; labels of such rows are not learned (none where it is omitted).
    """
    held = held_out if held_out is not None else F.lit(False)
    x = durable(vectors(docs, doc_id, text), "vectors")
    known = labels.select(F.col(doc_id).alias(doc_id), F.col(label).alias("label")).filter(F.col("label").isin(0, 1)).filter(~held)
    known = known.groupBy(doc_id, "label").agg(F.count(F.lit(1)).alias("weight"))  # many labels of an id are two rows at most
    model = fit(x.join(known, doc_id).select("x", "label", "weight"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column(1).flatten().to_numpy().reshape(-1, N_FEATURES)
                s = shared.value.scores(v) if shared.value else np.full(len(v), 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype("i4"))], [doc_id, "score", "predicted"])

    scored = x.select(doc_id, "x").mapInArrow(run, f"`{doc_id}` {kind}, score double, predicted int")
    return scored.select(doc_id, held.alias("held_out"), "score", "predicted")


def held_out(doc_id: str = "doc_id") -> Column:
    return fold(F.col(doc_id), 3) == 1
