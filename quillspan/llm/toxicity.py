"""Toxicity: a sparse logistic classifier with a penalty on counterfactual score changes.

A text is the set of its words and of their beginnings of 4, 5 and 6 letters.  Training takes a bounded sample of
labelled documents: at most ``sample`` of each class, those with the smallest hashes.  For each sampled text that
names a group, copies are made in which that group is swapped for others; the squared change of the score between text
and copy is added to the loss, so that naming a group does not move the score by itself.  The absolute penalty leaves
few features with a weight, which are broadcast (their number is bounded by the sample, not the corpus).

Defined results: null and empty texts have no words and get the score of an empty set; labels that are null or neither
0 nor 1 are ignored; repeated rows count and are returned each; without labels of both classes every score is 0.5;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, small

#: Fixed groups of identity terms; terms of one group are swapped for each other.
IDENTITY_TERMS = (
    ("man", "woman"), ("men", "women"), ("boy", "girl"), ("male", "female"), ("he", "she"), ("father", "mother"), ("husband", "wife"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("immigrant", "native"), ("immigrants", "natives"), ("old", "young"), ("disabled", "blind", "deaf"),
    ("american", "mexican", "chinese", "indian", "russian", "german", "french", "spanish"), ("homme", "femme"), ("hommes", "femmes"),
    ("mann", "frau"), ("männer", "frauen"), ("hombre", "mujer"), ("hombres", "mujeres"),
)
_SPLIT = re.compile(r"[\W\d_]+")


def word_features(token: str) -> tuple[int, ...]:
    """Features of a lower-case stretch without blanks, as crc32: its words and their beginnings (marked by a final *)."""
    out = []
    for w in _SPLIT.split(token):
        if w:
            out.append(crc32(w.encode(errors="replace")))
            out += [crc32((w[:n] + "*").encode(errors="replace")) for n in (4, 5, 6) if len(w) > n]
    return tuple(out)


def tokens(text: str | None) -> set[str]:
    return set(text.lower().split()) if text else set()


def features(text: str | None, kept: dict[str, tuple[int, ...]], room: int = 200_000) -> set[int]:
    """The features of a whole text; ``kept`` holds those of its stretches for reuse."""
    out: set[int] = set()
    for t in tokens(text):
        f = kept.get(t)
        if f is None:
            f = word_features(t)
            if len(t) < 100:
                if len(kept) >= room:
                    kept.clear()
                kept[t] = f
        out.update(f)
    return out


_TERMS = {crc32(t.encode()): (t, g) for g in IDENTITY_TERMS for t in g}


def counterfactuals(found: np.ndarray) -> list[tuple[set[int], set[int]]]:
    """For each identity term among the features and each other term of its row, what goes and what comes with the swap."""
    own, out = set(found.tolist()), []
    for h in sorted(own & _TERMS.keys()):
        term, row = _TERMS[h]
        gone = set(word_features(term))
        for other in (set(word_features(x)) for x in row if x != term):
            out.append((gone - other, other - own))
    return out


@dataclass(frozen=True)
class Toxicity:
    bias: float
    weights: dict[int, float]
    converged: bool = True

    def score(self, features: set[int]) -> float:
        z = self.bias + sum(self.weights[f] for f in features if f in self.weights)
        return 1 / (1 + math.exp(-min(max(z, -500.0), 500.0)))


class _Sparse:
    """A matrix of +1 and -1 by coordinates, for products with few numpy calls."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, sign: np.ndarray | None, n: int, m: int):
        order = np.argsort(cols, kind="stable")
        self.rows, self.cols, self.sign, self.n, self.m = rows[order], cols[order], None if sign is None else sign[order], n, m

    def times(self, w: np.ndarray) -> np.ndarray:
        x = w[self.cols]
        return np.bincount(self.rows, x if self.sign is None else x * self.sign, self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        x = g[self.rows]
        return np.bincount(self.cols, x if self.sign is None else x * self.sign, self.m)


def train(
    texts: list[np.ndarray], y: np.ndarray, swap: float = 1.0, sparse: float = 4e-4, least: int = 5, screen: float = 2.5, tolerance: float = 1e-7, rounds: int = 20_000
) -> Toxicity | None:
    """Accelerated proximal gradient on the mean log loss, each class with half the weight, until it has converged.

    Left out: features that fewer than ``least`` of the sampled texts have, and those whose shares in the two classes
    differ by less than ``screen`` standard errors.  Identity terms always stay.  Each weight has a step of its own, by
    how often its feature occurs, so rare features do not wait for frequent ones; the momentum starts anew where the
    objective rises.  It stops where ten rounds lower the objective by less than ``tolerance`` of it; if ``rounds`` do not
    get there, the weights with the least objective are taken, and ``converged`` is false.
    """
    if not len(y) or y.min() == y.max():
        return None
    seen, times = np.unique(np.concatenate(texts), return_counts=True)
    toxic, n1 = np.concatenate([t for t, c in zip(texts, y, strict=True) if c == 1]), float((y == 1).sum())
    hits = np.bincount(np.searchsorted(seen, toxic), minlength=len(seen))
    share = times / len(y)
    error = np.sqrt(share * (1 - share) * (1 / n1 + 1 / (len(y) - n1))) + 1e-12
    apart = np.abs(hits / n1 - (times - hits) / (len(y) - n1)) >= screen * error
    index = seen[(times >= least) & apart]
    swaps = [x for t in texts for x in counterfactuals(t)]
    index = np.union1d(index, np.array(sorted({f for x in swaps for part in x for f in part}), np.uint32))
    kept = [np.searchsorted(index, t[np.isin(t, index)]) for t in texts]
    m, n = len(index), len(texts)
    x = _Sparse(np.repeat(np.arange(n), [len(k) for k in kept]), np.concatenate(kept).astype(np.int64), None, n, m)
    signed = [(k, f, sign) for k, (gone, come) in enumerate(swaps) for part, sign in ((gone, 1.0), (come, -1.0)) for f in part]
    s_cols = np.searchsorted(index, np.array([f for _, f, _ in signed], np.uint32)).astype(np.int64)
    s = _Sparse(np.array([k for k, _, _ in signed], np.int64), s_cols, np.array([v for _, _, v in signed], float), max(len(swaps), 1), m)
    case = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    force = 2 * swap / max(len(swaps), 1)
    # each row's curvature, times its number of features, bounds the curvature of all its features together
    curve = x.back(0.25 * case * (np.bincount(x.rows, minlength=n) + 1)) + force * np.bincount(s.cols, np.bincount(s.rows, minlength=s.n)[s.rows], m)
    step, b_step = 1 / (curve + 1e-12), 1 / (0.25 * case * (np.bincount(x.rows, minlength=n) + 1)).sum()

    def loss(w: np.ndarray, b: float) -> float:
        z = x.times(w) + b
        return float(case @ np.logaddexp(0, np.where(y == 1, -z, z)) + 0.5 * force * np.square(s.times(w)).sum() + sparse * np.abs(w).sum())

    w, z, b, zb, t, last = np.zeros(m), np.zeros(m), 0.0, 0.0, 1.0, math.inf
    best = (loss(w, b), w, b)
    for k in range(rounds):
        g = case * (1 / (1 + np.exp(-np.clip(x.times(z) + zb, -500, 500))) - y)
        grad = x.back(g) + force * s.back(s.times(z))
        w2 = z - step * grad
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * sparse, 0)
        b2 = zb - b_step * g.sum()
        if (z - w2) @ ((w2 - w) / step) + (zb - b2) * (b2 - b) / b_step > 0:
            t = 1.0
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, zb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
        if k % 10 == 9:
            now = loss(w, b)
            if last - now < tolerance * max(now, 1e-9):
                return Toxicity(float(b), {int(index[j]): float(w[j]) for j in np.flatnonzero(w)})
            last, best = now, min(best, (now, w, b), key=lambda x: x[0])
    return Toxicity(float(best[2]), {int(index[j]): float(best[1][j]) for j in np.flatnonzero(best[1])}, False)


def sample_ids(labels: DataFrame, label: str, sample: int, doc_id: str = "doc_id") -> DataFrame:
    """At most ``sample`` ids of each class, those with the smallest hashes: two sorted limits, not a sort of all."""
    key = F.xxhash64(F.col(doc_id), F.lit("toxicity"))
    one = [labels.filter(F.col(label) == c).select(F.col(doc_id), F.lit(c).alias("label")).orderBy(key, doc_id).limit(sample) for c in (0, 1)]
    return one[0].unionByName(one[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 3000, doc_id: str = "doc_id", text: str = "text", **options) -> Toxicity | None:
    """Train on at most ``sample`` labels and as many rows of each class; the join broadcasts those ids (2 * sample at most)."""
    chosen = sample_ids(labels, label, sample, doc_id)
    joined = docs.select(doc_id, text).join(F.broadcast(chosen), doc_id).select(F.col(doc_id).cast("string"), "label", text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[int, ...]] = {}
        for batch in small(batches):
            f = [np.array(sorted(features(t.as_py(), kept)), "<u4").tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(f, pa.binary())], ["id", "label", "features"])

    found = joined.mapInArrow(run, "id string, label int, features binary").withColumn("h", F.xxhash64("id", "features"))
    # a repeated id may bring more rows than it was sampled for
    one = [found.filter(F.col("label") == c).orderBy("h", "features").limit(sample) for c in (0, 1)]
    rows = sorted((r[0] or "", r[1], bytes(r[2])) for r in one[0].unionByName(one[1]).collect())
    return train([np.frombuffer(r[2], "<u4") for r in rows], np.array([r[1] for r in rows], float), **options)


def classify(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``; one pass over whole texts after training."""
    held = held_out if held_out is not None else F.lit(False)
    model = fit(docs, labels.filter(~held), label, doc_id=doc_id, text=text, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known: dict[str, tuple[int, ...]] = {}  # of a stretch, the features that have a weight
        for batch in small(batches):
            scores = []
            for t in batch.column(1):
                hit: set[int] = set()
                for token in tokens(t.as_py()) if m else ():
                    f = known.get(token)
                    if f is None:
                        f = tuple(x for x in word_features(token) if x in m.weights)
                        if len(token) < 100:
                            if len(known) >= 400_000:
                                known.clear()
                            known[token] = f
                    if f:
                        hit.update(f)
                scores.append(m.score(hit) if m else 0.5)
            s = np.array(scores)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype("i4"))], [doc_id, "score", "predicted"])

    scored = docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, score double, predicted int")
    return scored.select(doc_id, held.alias("held_out"), "score", "predicted")


def held_out(doc_id: str = "doc_id") -> Column:
    return fold(F.col(doc_id), 5) == 0
