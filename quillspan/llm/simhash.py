"""SimHash near-duplicates: fingerprints, shard BK-trees, components.

A text's fingerprint has a bit set where over half of its shingles' hashes have it.  Fingerprints that may be near
meet in shards; a shard is held as a BK-tree, whose children are keyed by their distance to the parent, and a query
follows only edges within the radius of its own distance.  A shard's tree is sent to the task that holds its queries
instead of to every machine: broadcast trees would grow with the corpus.  Every shard of more than LEAF values is
searched through its tree.  Of the links in a shard only a spanning forest is kept, one link for each fingerprint at
most: a search takes what it reaches out of the tree, so a large group of near copies costs about one query a member.
Components join the forests by alternating star steps, until they settle.

Shards are made in two ways.  ``linked`` is exact: fingerprints of 64 bits are cut into blocks, and two that differ in
at most ``radius`` bits agree in all but ``radius`` blocks, so they meet in the shard of at least one choice of agreeing
blocks; the number of blocks, and of their bits that make the key, follows from the number of distinct fingerprints.
``alike`` is for a similarity, the Jaccard index of two texts' sets of shingles, too far for blocks: the keys are BANDS
bands of ROWS least hashes each, a fixed number at every size, the trees hold longer fingerprints, and a link is kept
only if the sets of the two whole texts have that index.  Two sets with an index of 0.8 share a band with probability
1 - (1 - 0.8^4)^16 = 0.9998.

A shard of more than ``most`` values is cut: first at random, in another way each turn, until a turn joins no
components any more or the parts are few (PIECES); if components are still apart then, all pairs of its parts are
searched (of exact shards with many parts, first the shards that further bits make of them).  So no link is lost, and a group of copies, which is one component after a turn or two, is never searched in
one task.

Defined results: a null text counts as empty; a text without words has fingerprint zero and is linked like any other;
a null id takes no part in the smallest id (a component of null ids has a null id); repeated rows are returned each by
``components`` and ``similar``; ``representatives`` keeps one row of each component, that of the smallest id (null last)
and then of the smallest hash of its text; other columns are ignored or passed on, whatever their names.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import durable, small

SHINGLE, RADIUS = 4, 4
LEAF, SHARD, MOST, PIECES = 8, 128, 256, 16
MOST_EXACT = 16_384  # of single words, whose comparison is cheap
BANDS, ROWS, FIRST = 16, 4, 4
EACH = 250_000  # links a task, where components are joined
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_ODD = np.random.default_rng(6).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str | None, width: int = SHINGLE, n_words: int = 1, repeats: bool = True, step: int = 1 << 14) -> np.ndarray:
    """64 bits for each of ``n_words``, from a whole text; the first word is that of XXH64 with seed 42, the others of
    hashes mixed from it.  Without ``repeats`` each different shingle counts once."""
    return _print(_hashes(text, width, repeats), n_words, step)


def _hashes(text: str | None, width: int, repeats: bool) -> np.ndarray:
    """Of a whole text's shingles, without ``repeats`` of the different ones."""
    words = _WORD.findall(text.translate(_LOWER)) if text else []
    if len(words) < width:
        shingles = [" ".join(words)] if words else []
    else:
        shingles = list(map(" ".join, zip(*[words[k:] for k in range(width)], strict=False)))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s.encode(errors="replace"), 42) for s in (shingles if repeats else set(shingles))], np.uint64)


def _print(every: np.ndarray, n_words: int, step: int = 1 << 14) -> np.ndarray:
    counts = np.zeros((n_words, 64), np.int64)
    for k in range(0, len(every), step):
        hashes = every[k : k + step]
        for w in range(n_words):
            bits = np.unpackbits((hashes if w == 0 else _mixed(hashes, w)).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            counts[w] += bits.sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(every), axis=1).view(">u8").astype(np.uint64).ravel()


def _mixed(h: np.ndarray, w: int) -> np.ndarray:
    """Other 64 bits of each hash: multiply and shift, twice, with odd constants."""
    x = h ^ np.uint64(0x9E3779B97F4A7C15 * w & (1 << 64) - 1)
    for c in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(c)
    return x ^ (x >> np.uint64(32))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, n_words: int = 1, repeats: bool = True) -> DataFrame:
    """doc_id and f0, f1, … (the fingerprint's words as signed bigints), one pass over whole texts."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = [f"f{w}" for w in range(n_words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            f = np.array([fingerprint(t.as_py(), width, n_words, repeats) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(f[:, w]) for w in range(n_words)]], ["id", *names])

    return docs.select(doc_id, text).mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} bigint" for n in names))


def bands(hashes: np.ndarray, step: int = 1 << 12) -> np.ndarray:
    """BANDS keys of a set of hashes, each of ROWS least values under different mixings; the same sets, the same keys."""
    if not len(hashes):
        return np.zeros(BANDS, np.int64)
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), step):
        x = hashes[k : k + step, None] * _ODD
        x ^= x >> np.uint64(32)
        x *= _ODD
        np.minimum(least, x.min(0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), 42) for r in rows], np.uint64).view(np.int64)


def _set_prints(docs: DataFrame, doc_id: str, text: str, width: int, n_words: int) -> DataFrame:
    """id, t (a hash of the text), node (a hash of its set of shingles), n (the set's size), f0, f1, … and bands."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = [f"f{w}" for w in range(n_words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [np.unique(_hashes(t.as_py(), width, False)) for t in batch.column(2)]
            f = np.array([_print(h, n_words) for h in sets], np.uint64).reshape(-1, n_words).view(np.int64)
            node = np.array([xxhash.xxh64_intdigest(h.tobytes(), 42) for h in sets], np.uint64).view(np.int64)
            n = pa.array([len(h) for h in sets], pa.int64())
            keys = pa.array([bands(h) for h in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node), n, *[pa.array(f[:, w]) for w in range(n_words)], keys], ["id", "t", "node", "n", *names, "bands"])

    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, t bigint, node bigint, n bigint, {', '.join(f'{n} bigint' for n in names)}, bands array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """node and shingles (the set's sorted hashes) of the ``wanted`` (row with id and t, node), from one whole text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [np.unique(_hashes(t.as_py(), width, False)).view(np.int64) for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["node", "shingles"])

    named = wanted.select(F.col("row.id").alias("__i"), F.col("row.t").alias("__t"), "node")
    texts = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    one = texts.join(named, (F.col("t") == F.col("__t")) & F.col("id").eqNullSafe(F.col("__i"))).select("node", "text")
    return one.mapInArrow(run, "node bigint, shingles array<bigint>").dropDuplicates(["node"])


class BKTree:
    """BK-tree over integers: a node's children are keyed by their Hamming distance to it, equal values share a node.

    What a search reaches can be taken out; branches with nothing left are passed by.  ``searches`` and ``visited`` count.
    """

    def __init__(self, values: Sequence[int]):
        self.value: list[int] = []
        self.held: list[list[int]] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []
        self.node_of: list[int] = []
        self.searches = self.visited = 0
        for at, value in enumerate(values):
            self.node_of.append(self._add(value, at))
        self.left = [len(h) for h in self.held]
        for q in range(len(self.left) - 1, 0, -1):  # a node comes after its parent
            self.left[self.parent[q]] += self.left[q]

    def _add(self, value: int, at: int) -> int:
        values, children = self.value, self.children
        q, distance = -1, 0
        if values:
            q = 0
            while distance := (values[q] ^ value).bit_count():
                child = children[q].get(distance)
                if child is None:
                    break
                q = child
            else:
                self.held[q].append(at)
                return q
            children[q][distance] = len(values)
        values.append(value)
        children.append({})
        self.held.append([at])
        self.parent.append(q)
        return len(values) - 1

    def remove(self, at: int) -> None:
        """Take one position out."""
        q = self.node_of[at]
        self.held[q].remove(at)
        while q >= 0:
            self.left[q] -= 1
            q = self.parent[q]

    def take(self, value: int, radius: int, accept: Callable[[int], bool] | None = None) -> list[int]:
        """Take out the positions within ``radius`` of ``value`` (of them those that ``accept`` agrees to)."""
        values, held, children, left = self.value, self.held, self.children, self.left
        found: list[int] = []
        pending = [0] if left and left[0] else []
        visited = 0
        while pending:
            q = pending.pop()
            visited += 1
            distance = (values[q] ^ value).bit_count()
            if distance <= radius and held[q]:
                found += held[q] if accept is None else [at for at in held[q] if accept(at)]
            for edge, child in children[q].items():
                if left[child] and -radius <= edge - distance <= radius:
                    pending.append(child)
        for at in found:
            self.remove(at)
        self.searches += 1
        self.visited += visited
        return found


def forest(values: Sequence[int], radius: int, accept: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``values``, as positions, by searches that take out what they reach.

    Two values are linked within ``radius`` if ``accept`` agrees.  Up to LEAF values are compared one by one.
    """
    n, links = len(values), []
    tree = BKTree(values) if n > LEAF else None
    rest = dict.fromkeys(range(n))
    while rest:
        start, _ = rest.popitem()
        if tree:
            tree.remove(start)
        frontier = [start]
        while frontier and rest:
            a = frontier.pop()
            if tree:
                found = tree.take(values[a], radius, accept and (lambda b, a=a: accept(a, b)))
            else:
                found = [b for b in rest if (values[a] ^ values[b]).bit_count() <= radius and (accept is None or accept(a, b))]
            for b in found:
                del rest[b]
                links.append((a, b))
            frontier += found
    return links


def choices_for(n: int, radius: int, bits: Sequence[int] = range(64), shard: int = SHARD) -> list[int]:
    """Masks of key bits, so that ``n`` unrelated fingerprints make shards of about ``shard``.

    Each takes its bits, some of ``bits``, from another choice of all but ``radius`` of the blocks; so two fingerprints
    that differ in ``radius`` bits or fewer are equal under one mask or more.  Few fingerprints are one shard.
    """
    wanted = math.ceil(math.log2(max(n, 1) / shard))
    if wanted <= 0:
        return [0]
    for blocks in range(radius + 1, 2 * radius + 5):
        if len(bits) * (blocks - radius) // blocks >= wanted:
            break
    cut = [part.tolist() for part in np.array_split(np.array(bits), blocks)]
    out = []
    for chosen in itertools.combinations(cut, blocks - radius):
        mixed = [b for row in itertools.zip_longest(*chosen) for b in row if b is not None]
        out.append(sum(1 << b for b in mixed[:wanted]))
    return out


def _shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each shard (equal first three columns), in a stream that is sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy() for k in range(3)]
        changes = np.flatnonzero(np.logical_or.reduce([np.diff(k) != 0 for k in keys])) + 1
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in range(3)):
            yield pa.Table.from_batches(held)
            held = []
        for a, z in itertools.pairwise([0, *changes.tolist(), batch.num_rows]):
            held.append(batch.slice(a, z - a))
            if z < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _wide(shard: pa.Table, names: list[str]) -> list[int]:
    """Fingerprints as integers."""
    out = None
    for w, name in enumerate(names):
        word = shard.column(name).to_numpy().view(np.uint64).tolist()
        out = word if out is None else [x | y << 64 * w for x, y in zip(out, word, strict=True)]
    return out


def _masks(hashes: np.ndarray, ends: np.ndarray, room: int = 1 << 22) -> list[int]:
    """Each set of a shard as an integer with a bit for each different hash; none for few sets, or beyond ``room`` bits."""
    n = len(ends) - 1
    if n <= 8:
        return []
    every, index = np.unique(hashes[ends[0] : ends[-1]], return_inverse=True)
    if n * len(every) > room:
        return []
    bits = np.zeros((n, len(every)), bool)
    bits[np.repeat(np.arange(n), np.diff(ends)), index] = True
    return [int.from_bytes(row.tobytes()) for row in np.packbits(bits, axis=1)]


def _searched(rows: DataFrame, names: list[str], radius: int, similarity: float | None) -> DataFrame:
    """a and b: a forest of the links in each shard of ``rows`` (choice, key, cut, node, part, ``names`` and, for a
    similarity, n and shingles).  Rows are dealt out by shard and sorted, so a task holds one shard at a time."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["choice", "key", "cut", "node", "part", *names, *(["n", "shingles"] if similarity else [])]
    dealt = rows.select(*columns).repartition(parts, "choice", "key", "cut").sortWithinPartitions("choice", "key", "cut", "node")

    def links_of(shard: pa.Table) -> list[tuple[int, int]]:
        part = shard.column("part").to_pylist()
        if similarity is None:
            return [(a, b) for a, b in forest(_wide(shard, names), radius) if part[a] != part[b]]
        n = shard.column("n").to_pylist()
        lists = shard.column("shingles").combine_chunks()
        hashes, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()

        masks = _masks(hashes, ends)

        def same(a: int, b: int) -> bool:
            if part[a] == part[b]:
                return True
            if min(n[a], n[b]) < similarity * max(n[a], n[b]) * (1 - 1e-9):
                return False
            if masks:
                shared = (masks[a] & masks[b]).bit_count()
            else:
                x, y = hashes[ends[a] : ends[a + 1]], hashes[ends[b] : ends[b + 1]]
                shared = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()) if len(x) else 0
            return shared >= similarity * (n[a] + n[b] - shared)

        return [(a, b) for a, b in forest(_wide(shard, names), radius, same) if part[a] != part[b]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for shard in _shards_of(batches):
            if links := links_of(shard):
                found.append(shard.column("node").to_numpy()[np.array(links, np.int64)])
                if len(found) >= 1000:
                    yield _pairs(found)
                    found = []
        if found:
            yield _pairs(found)

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.sort(np.concatenate(found), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _crowded(keyed: DataFrame) -> DataFrame:
    """choice, key and size of the shards that hold two components or more; of shards with the same nodes one."""
    hashes = [F.bit_xor(F.xxhash64("node", F.lit(s))).alias(f"x{s}") for s in (0, 1)]
    shards = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("size"), F.min("part").alias("low"), F.max("part").alias("high"), *hashes)
    return shards.filter("low != high").dropDuplicates(["size", "x0", "x1"]).select("choice", "key", "size")


def _joined(keyed: DataFrame, known: DataFrame | None, search: Callable[[DataFrame], DataFrame], most: int = MOST, finer: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Links (a, b) of the shards of ``keyed`` (choice, key, node), besides those ``known``, by ``search`` over rows of
    shards and their cuts; see above for shards of more than ``most``.  ``finer`` makes smaller shards, in which all links
    of such a one are, for use before all pairs of parts."""
    found, last = known, False
    for turn in itertools.count():
        own = keyed.withColumn("part", F.col("node")) if found is None else keyed.join(durable(connected(found), "parts").withColumnsRenamed({"f": "node", "root": "part"}), "node", "left").withColumn("part", F.coalesce("part", "node"))
        shards = durable(_crowded(own), "shards")
        largest = shards.agg(F.max("size")).first()[0] or 0
        cuts = F.ceil(F.col("size") / most)
        place = F.pmod(F.xxhash64("node", "choice", F.lit(turn)) if not last else F.xxhash64("node"), cuts)  # each choice in another way
        pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), cuts - 1), lambda j: F.least(j, place) * cuts + F.greatest(j, place))
        links = durable(search(own.join(shards, ["choice", "key"]).withColumn("cut", F.explode(pairs if last else F.array(place)))), "links")
        found = links if found is None else found.unionByName(links)
        if largest <= most or last:
            return found
        last = largest <= PIECES * most or links.isEmpty()
        # all links of shards that were not cut are found
        keyed = durable(keyed.join(shards.filter(F.col("size") > most).select("choice", "key"), ["choice", "key"], "left_semi"), "crowded")
        if last and finer and largest > PIECES * most:
            return _joined(durable(finer(keyed, largest), "finer"), found, search, most)


def linked(distinct: DataFrame, radius: int = RADIUS, n: int | None = None, most: int = MOST_EXACT) -> DataFrame:
    """a and b: links among the distinct 64-bit fingerprints f0, enough to connect whatever is connected."""
    masks = choices_for(distinct.count() if n is None else n, radius)
    signed = lambda every: [m - (1 << 64) if m >> 63 else m for m in every]
    keyed = distinct.select(F.col("f0").alias("node"), F.posexplode(F.array(*[F.col("f0").bitwiseAND(F.lit(m)) for m in signed(masks)])).alias("choice", "key"))

    def finer(rows: DataFrame, size: int) -> DataFrame:
        """Keys from the bits that a shard's own key leaves, by choices of blocks of these again."""
        more = [signed(choices_for(size, radius, [b for b in range(64) if not m >> b & 1])) for m in masks]
        own = F.get(F.array(*[F.array(*[F.lit(x).cast("bigint") for x in every]) for every in more]), F.col("choice"))
        apart = rows.select("node", "choice", "key", F.posexplode(own).alias("pos", "mask"))
        return apart.select("node", (F.col("choice") * 1000 + F.col("pos")).alias("choice"), F.xxhash64("key", F.col("node").bitwiseAND(F.col("mask"))).alias("key"))

    return _joined(keyed, None, lambda rows: _searched(rows.withColumn("f0", F.col("node")), ["f0"], radius, None), most, finer)


def alike(distinct: DataFrame, sets_of, n_words: int, similarity: float, most: int = MOST) -> DataFrame:
    """a and b: links among distinct sets of shingles (node, n, f0, …, bands) with a Jaccard index of ``similarity`` or
    more, enough to connect whatever sets with a common band connect.  ``sets_of`` gives the sets (node, shingles) of nodes.

    The first FIRST bands join most of what is alike; of the others only shards that still hold several components are
    searched.  The radius is over four standard deviations above the mean distance at that index.
    """
    names = [f"f{w}" for w in range(n_words)]
    total, apart = 64 * n_words, math.acos(2 * similarity / (1 + similarity)) / math.pi
    radius = math.ceil(total * apart + 4.4 * math.sqrt(total * apart * (1 - apart)))
    keyed = distinct.select("node", F.posexplode("bands").alias("choice", "key"))
    shared = _crowded(keyed.withColumn("part", F.col("node"))).drop("size")
    keyed = durable(keyed.join(shared, ["choice", "key"]), "keyed")  # most texts are like no other and are out of it here
    nodes = durable(keyed.select("node").distinct(), "nodes")
    sets = durable(sets_of(nodes).join(distinct.drop("bands"), "node"), "sets")
    search = lambda rows: _searched(rows.join(sets, "node"), names, radius, similarity)
    first = _joined(keyed.filter(F.col("choice") < FIRST), None, search, most)
    return _joined(keyed.filter(F.col("choice") >= FIRST), first, search, most)


def _counted(df: DataFrame, tag: str, **what: Column) -> tuple[DataFrame, dict]:
    """``df`` written, and aggregates of it that the same job has summed up."""
    seen = Observation()
    return durable(df.observe(seen, *[c.alias(k) for k, c in what.items()]), tag), seen.get


def connected(links: DataFrame) -> DataFrame:
    """f and root (the least of its component) for every end of a link but the roots, by alternating large and small stars.

    The ends are of any type with an order.  Rounds go on until all that is left are stars around roots, which the counts
    of a round's first table tell; each is written to the shared folder, by as many tasks as its rows need (EACH a task).
    Neighbours are never gathered: a star is a minimum for each node, summed up before the shuffle, and a plain join of
    two written tables, whose large partitions adaptive execution splits where a hub has many neighbours.
    """
    edges, seen = _counted(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links", ends=F.count(F.lit(1)))
    while True:
        tasks = max(1, math.ceil((seen["ends"] or 0) / EACH))
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")).coalesce(tasks)
        leaf = (F.col("n") == 1) & (F.col("m") < F.col("u"))
        least, seen = _counted(least, "least", ends=F.sum("n"), leaves=F.count_if(leaf))
        if (seen["ends"] or 0) == 2 * seen["leaves"]:  # each link leads from a leaf to its root: nothing is left to do
            return edges.select(F.col("u").alias("f"), F.col("v").alias("root"))
        large = durable(both.join(least.select("u", "m"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks), "stars")
        small_least = durable(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), "least")
        small = large.join(small_least, "u")
        edges = durable(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct().coalesce(tasks), "links")


def _row_order(doc_id: Column, t: Column) -> Column:
    """Rows by id, null last, then by the hash of their texts."""
    return F.struct(doc_id.isNull().alias("z"), doc_id.alias("id"), t.alias("t"))


def _named(distinct: DataFrame, links: DataFrame) -> DataFrame:
    """node, row and root: of each node (node, row) the least row of its component.

    Components are found over (row, node), so the least of a component holds its smallest id, and nothing is joined back.
    """
    order = distinct.select("node", F.struct("row", "node").alias("o"))
    ends = links.join(order.select(F.col("node").alias("a"), F.col("o").alias("x")), "a").join(order.select(F.col("node").alias("b"), F.col("o").alias("y")), "b")
    roots = connected(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("f.node").alias("node"), F.col("root.row").alias("root"))
    return durable(distinct.select("node", "row").join(roots, "node", "left"), "named")


def components(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``docs``: exact links of 64-bit fingerprints."""
    prints = durable(fingerprints(docs, doc_id, text, width), "prints")
    distinct = durable(prints.groupBy("f0").agg(F.min(_row_order(F.col("id"), F.lit(0))).alias("row")).withColumn("node", F.col("f0")), "distinct")
    named = _named(distinct, linked(distinct.select("f0"), radius)).select(F.col("node").alias("f0"), F.coalesce("root", "row")["id"].alias("component_id"))
    return prints.join(named, "f0").select(F.col("id").alias(doc_id), F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def _similar(docs: DataFrame, similarity: float, doc_id: str, text: str, width: int, n_words: int) -> tuple[DataFrame, DataFrame]:
    """The rows' prints, and their nodes named."""
    names = [f"f{w}" for w in range(n_words)]
    prints = durable(_set_prints(docs, doc_id, text, width, n_words), "prints")
    distinct = durable(prints.groupBy("node").agg(F.min(_row_order(F.col("id"), F.col("t"))).alias("row"), *[F.first(c).alias(c) for c in ("n", *names, "bands")]), "distinct")
    sets_of = lambda nodes: _sets(docs, distinct.select("row", "node").join(nodes, "node"), doc_id, text, width)
    return prints, _named(distinct, alike(distinct.select("node", "n", *names, "bands"), sets_of, n_words, similarity))


def similar(docs: DataFrame, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text", width: int = 5, n_words: int = 4) -> DataFrame:
    """doc_id and component_id of every row of ``docs``: links of whole texts whose sets of shingles have a Jaccard index
    of ``similarity`` or more.  Shards are bands of least hashes, their trees hold fingerprints of 64 * ``n_words`` bits."""
    prints, named = _similar(docs, similarity, doc_id, text, width, n_words)
    return prints.select("id", "node").join(named, "node").select(F.col("id").alias(doc_id), F.coalesce("root", "row")["id"].alias("component_id"))


def representatives(docs: DataFrame, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text", width: int = 5, n_words: int = 4) -> DataFrame:
    """One row of ``docs`` for each component of ``similar``, its least by id and hash of the text, with the columns of
    ``docs``.  Of rows equal in id and text the one is kept whose other columns have the least hash as JSON."""
    _, named = _similar(docs, similarity, doc_id, text, width, n_words)
    key = lambda i, t: (F.xxhash64(i, t).alias("__row_1"), F.hash(t, i).alias("__row_2"))
    keep = named.filter("root is null").select(*key(F.col("row.id"), F.col("row.t"))).distinct()
    rows = docs.select("*", *key(F.col(f"`{doc_id}`"), F.xxhash64(text)))
    kept = rows.join(keep, ["__row_1", "__row_2"], "left_semi")
    first = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]), {"ignoreNullFields": "false"})
    one = kept.groupBy("__row_1", "__row_2").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(F.xxhash64(first), first)).alias("__row"))
    return one.select("__row.*")
