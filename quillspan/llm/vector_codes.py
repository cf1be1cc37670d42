"""Product quantisation of vectors in integers, with partial-distance search.

A component x becomes floor(1024 * x); a vector is cut into equal parts, each with a codebook that a few rounds of
assignment and averaging move.  The nearest entry is searched dimension by dimension, those in which the codebook varies
most first: an entry is dropped by a mask over all vectors of a batch once its integer distance so far strictly exceeds
the best complete distance that the vector has.  Ties stay, and go to the lower index, so results equal a full search.

A round reads the integers once: each task sums up its vectors by entry, the sums of all tasks are summed up by Spark,
and only the codebooks (parts * entries rows) pass through the driver.  No vector is sampled; every round takes all.

Defined results: rows with a null vector, or with null or non-finite components, are dropped.  The dimension is that of
the kept vector of the least id, and vectors of another dimension are dropped too; if it is no multiple of the parts,
the first parts have a component more.  Null ids come last when entries are chosen, equal ids in the order of their
vectors; fewer vectors than entries make smaller codebooks.  Repeated rows are returned each.  Integers are held within
+-2^62, and errors at 2^63 - 1; where squares don't fit in 64 bits sums have no fixed width, so they are exact.  An empty table
gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, small

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
_MOST = 2**63 - 1


def integers(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, label and v (bigints) of the vectors whose components are all there and finite."""
    e = F.col(f"`{vector}`")
    finite = F.forall(e, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    v = F.transform(e, lambda x: F.least(F.greatest(F.floor(x.cast("double") * F.lit(float(scale))), F.lit(-(2**62))), F.lit(2**62)))
    return vectors.filter(e.isNotNull() & finite).select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), v.alias("v"))


def _width(*arrays: np.ndarray) -> type:
    """The type in which squared distances over these rows are exact: 64 bits while they hold them."""
    narrow = math.isqrt((1 << 60) // max(1, *(a.shape[1] for a in arrays)))
    return np.int64 if all(not a.size or max(-int(a.min()), int(a.max())) <= narrow for a in arrays) else object


def nearest(x: np.ndarray, book: np.ndarray, step: int = 512, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, the lower index of equal ones, by partial distances.

    ``seen`` counts the distance terms that were computed.
    """
    kind = _width(x, book)
    order = np.argsort(-np.var(book.astype(np.float64), axis=0), kind="stable")
    x, book = x[:, order].astype(kind), book[:, order].astype(kind)
    found = [_nearest(x[k : k + step], book, seen) for k in range(0, len(x), step)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, kind)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _nearest(x: np.ndarray, book: np.ndarray, seen: dict | None) -> tuple[np.ndarray, np.ndarray]:
    n, dims = x.shape
    if not dims:
        return np.zeros(n, np.int64), np.zeros(n, x.dtype)
    head = min(dims, 3)
    far = (x[:, 0, None] - book[None, :, 0]) ** 2
    for d in range(1, head):
        far += (x[:, d, None] - book[None, :, d]) ** 2
    guess = far.argmin(1)
    best = far[np.arange(n), guess] + ((x[:, head:] - book[guess, head:]) ** 2).sum(1)  # a complete distance of each
    row, entry = np.nonzero(far <= best[:, None])
    far = far[row, entry]
    terms = n * len(book) * head + n * (dims - head)
    for d in range(head, dims):
        far = far + (x[row, d] - book[entry, d]) ** 2
        terms += len(far)
        if d == dims - 1 or d % 2:
            stay = far <= best[row]
            row, entry, far = row[stay], entry[stay], far[stay]
        if d == (head + dims) // 2:  # the nearest so far is completed for a smaller best
            first = np.flatnonzero(np.diff(row, prepend=-1))
            least = np.minimum.reduceat(far, first)
            at = np.flatnonzero(far == np.repeat(least, np.diff(first, append=len(row))))
            at = at[np.flatnonzero(np.diff(row[at], prepend=-1))]
            best = np.minimum(best, far[at] + ((x[row[at], d + 1 :] - book[entry[at], d + 1 :]) ** 2).sum(1))
            stay = far <= best[row]
            row, entry, far = row[stay], entry[stay], far[stay]
    if seen is not None:
        seen["terms"] = seen.get("terms", 0) + terms
    first = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(far, first)
    at = np.flatnonzero(far == np.repeat(least, np.diff(first, append=len(row))))
    at = at[np.flatnonzero(np.diff(row[at], prepend=-1))]
    return entry[at].astype(np.int64), far[at]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _cuts(dims: int, parts: int) -> list[slice]:
    return [slice(int(c[0]), int(c[-1]) + 1) if len(c) else slice(0, 0) for c in np.array_split(np.arange(dims), parts)]


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks of ``rows`` (vec_id, v), one array (entries, components) a part; none for no rows."""
    start = [r["v"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    if not start:
        return []
    dims = len(start[0])
    if any(len(v) != dims for v in start):
        same = rows.filter(F.size("v") == dims)
        start = [r["v"] for r in same.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    cuts = _cuts(dims, parts)
    first = np.array(start, np.int64).reshape(len(start), dims)
    books = [first[:, c] for c in cuts]
    rows = rows.filter(F.size("v") == dims)
    for _ in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast(books)  # parts * entries rows, whatever the input

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            every = [(np.zeros(b.shape, object), np.zeros(len(b), np.int64)) for b in sent.value]
            for batch in small(batches, 4096):
                v = _matrix(batch.column(0), dims)
                for cut, book, (total, count) in zip(cuts, sent.value, every, strict=True):
                    at, _ = nearest(v[:, cut], book)
                    here = np.zeros(book.shape, _width(v[:, cut]))
                    np.add.at(here, at, v[:, cut])
                    total += here
                    count += np.bincount(at, minlength=len(book))
            for p, (total, count) in enumerate(every):
                used = np.flatnonzero(count)
                lists = [[str(t) for t in total[e]] for e in used]
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array(count[used]), pa.array(lists, pa.list_(pa.string()))], ["part", "entry", "n", "sums"])

        told = rows.select("v").mapInArrow(sums, "part int, entry int, n bigint, sums array<string>")
        summed = told.select("part", "entry", "n", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        books = [b.copy() for b in books]
        for r in summed.collect():  # an integer for each component of each entry
            books[r["part"]][r["entry"], r["at"]] = int(r["x"]) // r["n"]
        sent.unpersist()
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' decimal components, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def assign(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of ``rows`` (vec_id, label, v) of the codebooks' dimension."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    dims = sum(b.shape[1] for b in books)
    cuts = _cuts(dims, len(books) or 1)
    digits = max(2, *(len(f"{len(b) - 1:x}") for b in books)) if books else 2
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 4096):
            v = _matrix(batch.column(2), dims)
            found = [nearest(v[:, cut], book) for cut, book in zip(cuts, sent.value, strict=True)]
            code = ["".join(f"{i:0{digits}x}" for i in at) for at in zip(*(at.tolist() for at, _ in found), strict=True)]
            error = [min(sum(map(int, e)), _MOST) for e in zip(*(e.tolist() for _, e in found), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.filter((F.size("v") == dims) & F.lit(bool(books))).select("vec_id", "label", "v").mapInArrow(run, f"{kinds}, code string, error bigint")


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (error summed over equal labels) and codebooks_sha256 of every kept vector."""
    rows = durable(integers(vectors, vec_id, vector, label), "integers")
    books = train(rows, parts, entries, rounds)
    coded = durable(assign(rows, books), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy(F.col("label").alias("l")).agg(total.alias("label_error"))
    return coded.join(sums, coded["label"].eqNullSafe(sums["l"])).select(F.col("vec_id").alias(vec_id), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
