"""Nesting: elements of marked-up texts as a tree in rows, nodes within a range, and running depth over long texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import durable

#: Fixed: elements without an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
_MARK = re.compile(r"<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<(/?)([a-z][a-z0-9]*)\b[^>]*>|<![^>]*>", re.S | re.I)
_RAW = re.compile(r"<(script|style)\b", re.I)
_NODES = "node int, parent int, tag string, `start` int, `end` int, parent_start int, parent_end int"


def tree(text: str) -> list[tuple]:
    """(node, parent, tag, start, end) of the elements of a text, numbered in their order; ``end`` is exclusive.

    One pass with a stack.  An element without its end tag ends where the end tag of an element around it begins, or with
    the text; an end tag without a start tag is passed by; void elements, those closed in themselves, scripts and
    styles hold no others; comments and declarations are none.
    """
    nodes: list[list] = []
    stack: list[int] = []
    for m in _MARK.finditer(text):
        raw = _RAW.match(m[0])
        if not raw and not m[2]:
            continue
        tag = (raw[1] if raw else m[2]).lower()
        if not raw and m[1]:
            at = next((k for k in reversed(range(len(stack))) if nodes[stack[k]][2] == tag), None)
            if at is not None:
                for q in stack[at + 1 :]:
                    nodes[q][4] = m.start()
                nodes[stack[at]][4] = m.end()
                del stack[at:]
            continue
        nodes.append([len(nodes), stack[-1] if stack else None, tag, m.start(), m.end()])
        if not raw and tag not in VOID and not m[0].endswith("/>"):
            stack.append(len(nodes) - 1)
    for q in stack:
        nodes[q][4] = len(text)
    return [tuple(n) for n in nodes]


def elements(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and node, parent, tag, start, end, parent_start, parent_end of all elements; null texts have none."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = tree(batch.column(1)[k].as_py() or "")
                if rows:
                    above = [rows[r[1]][3:5] if r[1] is not None else (None, None) for r in rows]
                    columns = [pa.array([r[j] for r in rows], pa.string() if j == 2 else pa.int32()) for j in range(5)]
                    columns += [pa.array([a[j] for a in above], pa.int32()) for j in range(2)]
                    same = batch.column(0).take(pa.array([k] * len(rows)))
                    yield pa.RecordBatch.from_arrays([same, *columns], [key, "node", "parent", "tag", "start", "end", "parent_start", "parent_end"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {_NODES}")


def maximal(nodes: DataFrame, start: Column, end: Column) -> DataFrame:
    """The nodes within ``start`` to ``end`` (exclusive) whose parents are not within it.  No join: rows know their parents."""
    within = (F.col("start") >= start) & (F.col("end") <= end)
    above = F.coalesce((F.col("parent_start") >= start) & (F.col("parent_end") <= end), F.lit(False))
    return nodes.filter(within & ~above)


def depths(docs: DataFrame, key: str, text: str, opening: str = "<", closing: str = ">", chunk: int = 1 << 16, order: str | None = None) -> DataFrame:
    """``key``, piece, chunk, at and depth: the running depth after each opening or closing mark (one character each).

    Texts are cut into chunks of ``chunk`` characters, which are dealt out, so one long text is scanned by many tasks.
    A chunk's summary is its sum; sums of the chunks before it are added to its own running sums.  A text may also come
    in several rows, in the order of the column ``order`` (equal ones are one piece only if they are one row: order must
    tell rows of a key apart).
    """
    marks = "[" + re.escape(opening) + re.escape(closing) + "]"
    piece = F.col(order) if order else F.lit(0)
    cut = docs.select(F.col(key).alias("key"), piece.alias("piece"), F.posexplode(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))).alias("chunk", "body"))
    found = cut.select("key", "piece", "chunk", F.posexplode(F.regexp_extract_all("body", F.lit(marks), F.lit(0))).alias("at", "mark"))
    found = durable(found.select("key", "piece", "chunk", "at", F.when(F.col("mark") == opening, 1).otherwise(-1).alias("x")), "marks")
    before = Window.partitionBy("key").orderBy("piece", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = found.groupBy("key", "piece", "chunk").agg(F.sum("x").alias("x"))  # one row a chunk, without its text
    firsts = sums.select(F.col("key").alias("k"), F.col("piece").alias("p"), F.col("chunk").alias("c"), F.coalesce(F.sum("x").over(before), F.lit(0)).alias("first"))
    own = found.withColumn("own", F.sum("x").over(Window.partitionBy("key", "piece", "chunk").orderBy("at")))
    met = own.join(firsts, own["key"].eqNullSafe(firsts["k"]) & own["piece"].eqNullSafe(firsts["p"]) & (own["chunk"] == firsts["c"]))
    return met.select(F.col("key").alias(key), "piece", "chunk", "at", (F.col("own") + F.col("first")).alias("depth"))
