"""Many names at once: an automaton of all names, sent to the tasks once, and one pass over the texts.

The automaton's size is checked before it is sent: names are dealt out in shards of MOST characters at most, by their
hashes, and texts are passed once for each shard; so any number of names is found, and one is never too large.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 4_000_000
_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def automaton(names: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for n in names:
        out.add_word(n, n)
    out.make_automaton()
    return out


def occurrences(text: str, machine: ahocorasick.Automaton, whole: bool) -> dict[str, tuple[int, int]]:
    """Of each name in a text how often it occurs, overlaps too, and where first; ``whole``: not inside of a word."""
    found: dict[str, tuple[int, int]] = {}
    for last, name in machine.iter(text):
        at = last - len(name) + 1
        if whole and (at and text[at - 1] in _WORD and name[0] in _WORD or last + 1 < len(text) and text[last + 1] in _WORD and name[-1] in _WORD):
            continue
        n, first = found.get(name, (0, at))
        found[name] = (n + 1, min(first, at))
    return found


def found(docs: DataFrame, names: DataFrame, key: str, text: str, whole: bool = True, most: int = MOST) -> DataFrame:
    """``key``, name, n and first (offset in characters) of the ``names`` (name) in the texts of ``docs``.

    Null and empty names and null texts have no rows; repeated names count once; rows of a repeated key are told each.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    wanted = names.select("name").filter("name != ''").distinct()
    size = wanted.agg(F.sum(F.length("name")).alias("n"), F.max(F.length("name")).alias("longest")).first()
    shards = max(1, -(-2 * (size["n"] or 0) // most))
    out = None
    for shard in range(shards):
        here = wanted if shards == 1 else wanted.filter(F.pmod(F.xxhash64("name"), F.lit(shards)) == shard)
        sent = spark.sparkContext.broadcast(sorted(r[0] for r in here.collect()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            machine = automaton(sent.value) if sent.value else None
            for batch in batches if machine else ():
                rows = [(k, name, *x) for k in range(batch.num_rows) for name, x in sorted(occurrences(batch.column(1)[k].as_py() or "", machine, whole).items())]
                same = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([same, pa.array([r[1] for r in rows], pa.string()), *[pa.array([r[j] for r in rows], pa.int32()) for j in (2, 3)]], [key, "name", "n", "first"])

        part = docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, name string, n int, `first` int")
        out = part if out is None else out.unionByName(part)
    return out
