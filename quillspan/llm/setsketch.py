"""MinHash-like near-duplicates by SetSketch: registers, bands of them, a joint likelihood, and exact sets at the end.

A register is the least of a set's exponential values (one for each shingle, of another mixing a register), shown on an
exponential scale of base BASE and truncated to 16 bits; so the registers of a union are the greater of its parts', and
equal ones tell of similarity as MinHash values do.  Keys are bands of equal registers.  In a shard (the sets with the same
key) a pair is a candidate if the joint likelihood of its registers does not put the Jaccard index far below the wanted
one: the likelihood is concave, so its estimate is above a value exactly where its slope there is not negative, and one
slope decides.  A candidate is a link only if the full sets have the index.

Two sets with an index of 0.85 share one of 16 bands of four registers with probability 0.99999 or more; the slope is
taken five standard deviations below.  Of the links in a shard a spanning forest is kept; shards that are too large are
cut as in ``simhash``, so a large group of copies is never searched in one task and no link between different sets is
lost.  Equal sets are one node from the start.

Defined results: a document without words or text has the empty set and is linked with nothing, empty ones neither; a
null id takes no part in the smallest id (a component of null ids has a null id, and its rows are kept); repeated rows
are returned each; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, small
from .simhash import PIECES, _counted, _hashes, _named, _pairs, _row_order, _sets, _shards_of, connected

WIDTH, PERCENT = 3, 85
REGISTERS, BASE, RATE, TOP = 64, 1.001, 20.0, 65535
BAND, FIRST, MOST, ROOM = 4, 4, 1024, 4_000_000
_ODD = np.random.default_rng(11).integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)


def registers(hashes: np.ndarray, step: int = 1 << 9) -> np.ndarray:
    """REGISTERS 16-bit registers of a set of 64-bit hashes, zero for the empty set; parts are merged as they come."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), step):
        x = hashes[k : k + step, None] * _ODD
        x ^= x >> np.uint64(32)
        x *= _ODD
        np.minimum(least, x.min(0), out=least)
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 2.0**-52)) / RATE
    return np.clip(np.floor(1 - np.log(value) / math.log(BASE)), 0, TOP).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def cardinality(k: np.ndarray) -> float:
    """Estimated number of the set's elements."""
    if not k.any():
        return 0.0
    return float(len(k) * (1 - 1 / BASE) / (RATE * math.log(BASE) * (BASE ** -k.astype(np.float64)).sum()))


def _slope(less: np.ndarray, more: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the joint log-likelihood at the Jaccard index ``at``, where ``less`` registers of a are below those of b and
    ``more`` above: p(x) = -log_BASE(1 - x (BASE - 1) / BASE) is the probability that a's is above with x = u - v J."""
    u, v, c = n_a / (n_a + n_b), n_b / (n_a + n_b), (BASE - 1) / BASE
    x, y = np.maximum(u - v * at, 1e-9), np.maximum(v - u * at, 1e-9)
    p, q = -np.log1p(-x * c) / math.log(BASE), -np.log1p(-y * c) / math.log(BASE)
    dp, dq = -v * c / math.log(BASE) / (1 - x * c), -u * c / math.log(BASE) / (1 - y * c)
    return more * dp / p + less * dq / q - (REGISTERS - less - more) * (dp + dq) / np.maximum(1 - p - q, 1e-12)


def estimate(a: np.ndarray, b: np.ndarray, n_a: float, n_b: float) -> float:
    """The Jaccard index of greatest likelihood for two sets of ``n_a`` and ``n_b`` elements (``cardinality`` if unknown)."""
    less, more, low, high = int((a < b).sum()), int((a > b).sum()), 0.0, min(n_a / n_b, n_b / n_a)
    for _ in range(40):
        middle = (low + high) / 2
        if _slope(np.float64(less), np.float64(more), n_a, n_b, np.float64(middle)) >= 0:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def likely(a: np.ndarray, every: np.ndarray, n_a: int, n_b: np.ndarray, index: float) -> np.ndarray:
    """Which rows of ``every`` have an estimated index with ``a`` that is not far below ``index``."""
    at = max(0.0, index - 5 * math.sqrt(index * (1 - index) / REGISTERS))
    less, more = (a < every).sum(1), (a > every).sum(1)
    near = np.minimum(n_a, n_b) >= index * (1 - 1e-9) * np.maximum(n_a, n_b)
    return near & (_slope(less, more, np.float64(n_a), n_b.astype(np.float64), np.float64(at)) >= 0)


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """id, t (a hash of the text), node (a hash of its set of shingles), n (the set's size) and registers (binary)."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [np.unique(_hashes(t.as_py(), width, False)) for t in batch.column(2)]
            node = np.array([xxhash.xxh64_intdigest(h.tobytes(), 42) for h in sets], np.uint64).view(np.int64)
            k = pa.array([registers(h).astype("<u2").tobytes() for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node), pa.array([len(h) for h in sets], pa.int64()), k], ["id", "t", "node", "n", "registers"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(f"`{text}`").alias("t"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, t bigint, node bigint, n bigint, registers binary")


def _links_of(shard: pa.Table, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of a shard's links, as positions; rows of the same part are linked already."""
    part, n = shard.column("part").to_numpy(), shard.column("n").to_numpy()
    k = np.frombuffer(b"".join(shard.column("registers").to_pylist()), "<u2").reshape(-1, REGISTERS)
    lists = shard.column("shingles").combine_chunks()
    hashes, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
    different, index = np.unique(hashes[ends[0] : ends[-1]], return_inverse=True)
    starts, here = ends[:-1] - ends[0], np.zeros(len(different), bool)
    links, rest = [], np.arange(len(part))

    def shared(a: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of the full sets."""
        own = index[starts[a] : starts[a] + n[a]]
        here[own] = True
        if len(others) > 16:
            out = np.add.reduceat(here[index], starts, dtype=np.int64)[others]
        else:
            out = np.array([here[index[starts[b] : starts[b] + n[b]]].sum() for b in others.tolist()], np.int64)
        here[own] = False
        return out

    while len(rest):
        frontier, rest = [int(rest[-1])], rest[:-1]
        while frontier and len(rest):
            a = frontier.pop()
            known = part[rest] == part[a]
            wanted = np.flatnonzero(~known & likely(k[a], k[rest], int(n[a]), n[rest], percent / 100))
            common = shared(a, rest[wanted])
            new = rest[wanted[100 * common >= percent * (n[a] + n[rest[wanted]] - common)]]
            if len(new) or known.any():
                links += [(a, b) for b in new.tolist()]
                frontier += [*rest[known].tolist(), *new.tolist()]
                rest = rest[~known & ~np.isin(rest, new)]
    return links


def _searched(rows: DataFrame, percent: int) -> DataFrame:
    """a and b: a forest of the links in each shard of ``rows`` (choice, key, cut, node, part, n, registers, shingles)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("choice", "key", "cut", "node", "part", "n", "registers", "shingles").repartition(parts, "choice", "key", "cut").sortWithinPartitions("choice", "key", "cut", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards_of(batches):
            if links := _links_of(shard, percent):
                yield _pairs([shard.column("node").to_numpy()[np.array(links, np.int64)]])

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _busy(keyed: DataFrame, most: int) -> DataFrame:
    """choice, key and cuts of the shards that hold two components or more; of shards with the same nodes one.

    A shard is cut into parts of ``most`` sets, or of ROOM shingles, at most on average.
    """
    hashes = [F.bit_xor(F.xxhash64("node", F.lit(s))).alias(f"x{s}") for s in (0, 1)]
    shards = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("room"), F.min("part").alias("low"), F.max("part").alias("high"), *hashes)
    cuts = F.ceil(F.greatest(F.col("size") / most, F.col("room") / ROOM))
    return shards.filter("low != high").dropDuplicates(["size", "x0", "x1"]).select("choice", "key", cuts.alias("cuts"))


def linked(distinct: DataFrame, sets_of, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """a and b: links among distinct sets (node, n, registers), enough to connect whatever sets with a common band connect.

    The first FIRST bands join most of what is alike; then the other bands have their turn, and of all shards only those
    that still hold several components.  A shard that is cut comes again: at random in another way, until a turn joins
    nothing or the parts are few, then in all pairs of its parts.  ``sets_of`` gives the sets (node, shingles) of nodes.
    """
    keys = F.array(*[F.xxhash64(F.substring("registers", 2 * BAND * j + 1, 2 * BAND)) for j in range(REGISTERS // BAND)])
    keyed = distinct.select("node", "n", F.posexplode(keys).alias("choice", "key"))
    shared = _busy(keyed.withColumn("part", F.col("node")), most).drop("cuts")
    keyed = durable(keyed.join(shared, ["choice", "key"]), "keyed")  # most texts are like no other and are out of it here
    sets = durable(sets_of(keyed.select("node").distinct()).join(distinct, "node"), "sets")
    found, last = None, False
    for turn in itertools.count():
        here = keyed.filter(F.col("choice") < FIRST) if turn == 0 else keyed
        if found is None:
            own = here.withColumn("part", F.col("node"))
        else:
            own = here.join(durable(connected(found), "parts").withColumnsRenamed({"f": "node", "root": "part"}), "node", "left").withColumn("part", F.coalesce("part", "node"))
        shards, seen = _counted(_busy(own, most), "shards", pieces=F.max("cuts"))
        place = F.pmod(F.xxhash64("node") if last else F.xxhash64("node", "choice", F.lit(turn)), F.col("cuts"))
        pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("cuts") - 1), lambda j: F.least(j, place) * F.col("cuts") + F.greatest(j, place))
        rows = own.join(shards, ["choice", "key"]).withColumn("cut", F.explode(pairs if last else F.array(place))).drop("n")
        links, told = _counted(_searched(rows.join(sets, "node"), percent), "links", n=F.count(F.lit(1)))
        found = links if found is None else found.unionByName(links)
        pieces = seen["pieces"] or 0
        if turn and (last or pieces <= 1):
            return found
        last = 1 < pieces <= PIECES or pieces > 1 and not told["n"]
        cut = shards.filter("cuts > 1").select("choice", "key", F.lit(True).alias("again"))
        keyed = keyed.join(cut, ["choice", "key"], "left").filter(F.col("again") | ((F.col("choice") >= FIRST) if turn == 0 else F.lit(False))).drop("again")


def components(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, most: int = MOST) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``: links of sets of ``width``-word shingles whose
    intersection is ``percent`` hundredths of their union or more; shards of more than ``most`` sets are cut."""
    prints = durable(sketches(docs, doc_id, text, width), "sketches")
    distinct = durable(prints.filter("n > 0").groupBy("node").agg(F.min(_row_order(F.col("id"), F.col("t"))).alias("row"), F.first("n").alias("n"), F.first("registers").alias("registers")), "distinct")
    sets_of = lambda nodes: _sets(docs, distinct.select("row", "node").join(nodes, "node"), doc_id, text, width)
    named = _named(distinct, linked(distinct.select("node", "n", "registers"), sets_of, percent, most)).select("node", F.coalesce("root", "row")["id"].alias("least"))
    # empty sets have no node to meet in
    full = prints.filter("n > 0").join(named, "node").select("id", "n", "least")
    rows = full.unionByName(prints.filter("n = 0").select("id", "n", F.col("id").alias("least")))
    return rows.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), F.col("id").eqNullSafe(F.col("least")).alias("kept"))
