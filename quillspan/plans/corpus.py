"""A corpus with its derived tables, kept for reuse by root and options."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, postings, reach, resolve
from ..operators import symbols as sym
from ..operators.scripts import parsed
from ..sources import corpus as source
from ..storage import durable


@dataclass
class Corpus:
    """Tables of one corpus; each is planned once.  ``mode``: reference or corrected, see the README."""

    files: DataFrame
    mode: str = "reference"
    _edges: dict = field(default_factory=dict)
    _reached: dict = field(default_factory=dict)

    @cached_property
    def symbols(self) -> DataFrame:
        return sym.symbols(self.files, self.mode)

    @cached_property
    def imports(self) -> DataFrame:
        return sym.imports(self.files)

    def resolved(self, rule: str = "graph") -> DataFrame:
        """src, ord, source and dst of the imports that resolve, by the rule of a tool."""
        listing = resolve.with_folders(self.files) if rule in ("trace", "dead_code") else self.files
        return resolve.resolve(self.imports, listing, rule, self.mode)

    def edges(self, rule: str = "graph") -> DataFrame:
        """src and dst of imports between files, by the rule of a tool."""
        if rule not in self._edges:
            found = resolve.edges(self.resolved(rule))
            self._edges[rule] = found.join(self.files.select(F.col("path").alias("dst")), "dst", "left_semi").select("src", "dst")
        return self._edges[rule]

    @cached_property
    def names(self) -> postings.Postings:
        """The index of identifiers of script files: token, key (the path) and positions among the file's identifiers."""
        places = parsed(self.files, ("identifiers",)).select(F.col("path").alias("key"), F.posexplode("identifiers.name").alias("at", "token"))
        return postings.Postings.build(postings.gathered(places))

    def naming(self, name: str) -> DataFrame:
        """The files that have the identifier ``name``, by the index: no other file is scanned for it."""
        return self.files.join(self.names.lookup(name).select(F.col("key").alias("path")), "path", "left_semi")

    def reached(self, seeds: list[str], rule: str = "graph") -> DataFrame:
        """node and depth of what ``seeds`` reach; kept, and brought up to date by ``refreshed``."""
        key = (rule, tuple(sorted(set(seeds))))
        if key not in self._reached:
            self._reached[key] = durable(graph.reachable(self.edges(rule), self._nodes(key[1])), "reached")
        return self._reached[key]

    def _nodes(self, paths: tuple[str, ...] | list[str]) -> DataFrame:
        return self.files.sparkSession.createDataFrame([(p,) for p in paths], "node string")

    def refreshed(self, changed: DataFrame, removed: list[str] | tuple[str, ...] = ()) -> Corpus:
        """The corpus after ``changed`` files (rows as a scan gives them) came in place of those with their paths and
        ``removed`` paths have gone.

        Only changed files are analysed: symbols and imports of the others are kept, and kept searches are brought up to
        date along the edges that differ.  Imports are resolved anew against the new listing, by joins alone.
        """
        changed = durable(changed, "changed")
        gone = durable(changed.select(F.col("path").alias("node")).union(self._nodes(removed)).distinct(), "gone")
        rest = lambda df: df.join(gone, df["path"] == gone["node"], "left_anti")
        fresh, out = Corpus(changed, self.mode), Corpus(rest(self.files).unionByName(changed), self.mode)
        out.__dict__["symbols"] = durable(rest(self.symbols).unionByName(fresh.symbols), "symbols")
        out.__dict__["imports"] = durable(rest(self.imports).unionByName(fresh.imports), "imports")
        for (rule, seeds), known in self._reached.items():
            before, after = durable(self.edges(rule), "edges"), durable(out.edges(rule), "edges")
            left = out.files.select(F.col("path").alias("node")).join(self._nodes(seeds), "node", "left_semi")
            told = reach.refreshed(known, before, before.subtract(after), after.subtract(before), left)
            out._reached[rule, seeds] = durable(told, "reached")
        return out

    def stats(self) -> DataFrame:
        return sym.index_stats(sym.with_symbols(self.files, self.mode))

    def without(self, paths: list[str]) -> Corpus:
        """The corpus with some files invalidated: their rows, nodes and edges go; nothing is read again."""
        out = Corpus(self.files.filter(~F.col("path").isin(paths)), self.mode)
        gone = self.files.sparkSession.createDataFrame([(p,) for p in paths], "node string")
        out._edges = {rule: graph.without(e, gone) for rule, e in self._edges.items()}
        return out


_KEPT: dict[tuple, Corpus] = {}
_LOCKS: dict[tuple, threading.Lock] = {}
_LOCK = threading.Lock()


def open_corpus(spark: SparkSession, root: str, mode: str = "reference", **options) -> Corpus:
    """The corpus below ``root``, its files persisted; the same root with the same options is scanned once.

    Callers from several threads wait for the first one's scan; those of other corpora don't.
    """
    key = (spark.sparkContext.applicationId, root, mode, tuple(sorted(options.items())))
    with _LOCK:
        own = _LOCKS.setdefault(key, threading.Lock())
    with own:
        if key not in _KEPT:
            _KEPT[key] = Corpus(source.scan(spark, root, **options).persist(), mode)
        return _KEPT[key]


def invalidate(root: str | None = None) -> int:
    """Forget the corpora below ``root`` (all without one); how many there were."""
    gone = [_KEPT.pop(k, None) for k in list(_KEPT) if root is None or k[1] == root]
    for c in gone:
        if c is not None:
            c.files.unpersist()
    return sum(c is not None for c in gone)


def cache_stats(n_files: int, n_nodes: int, hits: int, misses: int) -> dict:
    """Hit rate in percent and the memory estimate of 1000 bytes a file and 100 a node."""
    return {"hit_rate": 100.0 * hits / (hits + misses) if hits + misses else 0.0, "memory": 1000 * n_files + 100 * n_nodes}
