"""One function for each tool of the library's surface; they return DataFrames (``dict`` of them where several)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions import text as fx
from ..operators import coverage as cov
from ..operators import diffs, findings, graph, refactor, types
from ..operators import symbols as sym
from ..operators.scripts import parsed
from ..sources import corpus as source
from ..sources import reports
from .corpus import Corpus


def _array(*said) -> F.Column:
    return F.array_compact(F.array(*said))


def _or_good(said: F.Column, good: str) -> F.Column:
    """``said``, or one text where there is nothing to say."""
    return F.when(F.size(said) > 0, said).otherwise(F.array(F.lit(good)))


def context(corpus: Corpus, path: str | None = None) -> dict[str, DataFrame]:
    """files, edges (context rule) and one row of complexity, safety and recommendations."""
    files = corpus.files if path is None else corpus.files.filter((F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/"))
    one = sym.complexity_summary(files)
    above = F.col("n_above")
    one = one.withColumn("safety", scores.safety(F.col("average_complexity"), above))
    said = _array(
        F.when(F.col("safety") < 70, F.lit("Raise test coverage and lower complexity before changing the code.")),
        F.when(above > 0, F.concat(above, F.lit(" files are above the complexity threshold; simplify them first."))),
        F.lit("Cover the code with tests before changing it."),  # coverage is not measured here and counts as 0
    )
    return {"files": files, "edges": corpus.edges("context"), "above": sym.complex_files(files), "summary": one.withColumns({"safety_label": scores.safety_label(F.col("safety")), "recommendations": said})}


def impact(corpus: Corpus, path: str, symbol: str | None = None) -> dict[str, DataFrame]:
    """direct and transitive dependents of a file and one row of its risk."""
    edges = corpus.edges("impact")
    direct = graph.dependents(edges, path, own=False)
    far = graph.transitive_dependents(edges, path).filter(F.col("node") != path).select("node")
    stem, end = F.regexp_extract(F.lit(path), r"^(.*)\.(?:ts|js)$", 1), F.regexp_extract(F.lit(path), r"\.(ts|js)$", 1)
    folder, name = F.regexp_replace(stem, r"[^/]*$", ""), F.regexp_extract(stem, r"([^/]*)$", 1)
    # a target with another ending stands for its own tests, as a replacement that finds nothing changes nothing
    dot = F.lit(".")
    tests = F.when(stem != "", F.array(F.concat(stem, F.lit(".test"), dot, end), F.concat(stem, F.lit(".spec"), dot, end), F.concat(folder, F.lit("__tests__/"), name, F.lit(".test"), dot, end))).otherwise(F.array(F.lit(path)))
    part = lambda df, name, value: df.select(F.lit(name).alias("name"), value.cast("int").alias("value"))
    rows = part(direct, "direct", F.lit(1)).union(part(far, "transitive", F.lit(1)))
    rows = rows.union(part(corpus.files.filter(F.array_contains(tests, F.col("path"))), "tested", F.lit(1)))
    rows = rows.union(part(corpus.files.filter(F.col("path") == path), "complexity", F.col("complexity")))
    total = lambda name: F.coalesce(F.sum(F.when(F.col("name") == name, F.col("value"))), F.lit(0))
    counts = rows.agg(total("direct").alias("direct"), total("transitive").alias("transitive"), F.when(total("tested") > 0, 80.0).otherwise(0.0).alias("coverage"), total("complexity").alias("complexity"))
    one = counts.withColumns({"total": F.col("direct") + F.col("transitive"), "risk": scores.risk(F.col("direct"), F.col("transitive"), F.col("complexity"), F.col("coverage"))})
    said = _array(
        F.when(F.col("risk") > 70, F.lit("High risk: break the change into small ones.")),
        F.when(F.col("coverage") < 50, F.lit("The file has no test; add one first.")),
        F.when(F.col("direct") > 10, F.concat("direct", F.lit(" files import this one; set a checkpoint before the change."))),
        F.when(F.col("transitive") > 20, F.lit("Many files depend on this one at some remove; go in steps and run the tests after each.")),
        F.lit(f"Rename {symbol} by a tool that finds all its uses.") if symbol else F.lit(None).cast("string"),
    )
    return {"direct": direct, "transitive": far, "summary": one.withColumns({"risk_label": scores.risk_label(F.col("risk")), "recommendations": _or_good(said, "Low risk: go ahead.")})}


def analyze(corpus: Corpus, path: str | None = None) -> dict[str, DataFrame]:
    files = corpus.files if path is None else corpus.files.filter(F.col("path") == path)
    found = findings.opportunities(files, corpus.symbols.join(files.select("path"), "path", "left_semi"))
    kind = lambda x, text: F.when(F.count_if(F.col("type") == x) > 0, F.concat(F.count_if(F.col("type") == x), F.lit(text)))
    said = found.agg(
        _array(
            F.when(F.count(F.lit(1)) == 0, F.lit("Nothing stands out; the structure looks good.")),
            F.when(F.count_if(F.col("severity") == "high") > 0, F.concat(F.count_if(F.col("severity") == "high"), F.lit(" are severe; begin there."))),
            kind("file-too-large", " files are too large."),
            kind("function-too-complex", " functions branch too much."),
            kind("function-too-long", " functions are too long."),
            kind("class-too-large", " classes have too many methods."),
            F.when(F.count(F.lit(1)) > 0, F.lit("Set a checkpoint before the changes and run the checks after them.")),
        ).alias("recommendations")
    )
    return {"opportunities": found, "summary": findings.severity_summary(found), "recommendations": said}


def _with_symbols(corpus: Corpus, chains: DataFrame) -> DataFrame:
    """``chains`` with the symbols that the last but one file imports by name from the last."""
    rows = parsed(corpus.files, ("imported",)).select(F.col("path").alias("src"), F.explode("imported").alias("i")).filter("i.kind = 'named'").select("src", F.col("i.source").alias("source"), F.col("i.name").alias("name"))
    names = corpus.resolved("trace").join(rows, ["src", "source"]).groupBy("src", "dst").agg(F.array_sort(F.collect_set("name")).alias("symbols"))
    ends = chains.withColumns({"src": F.element_at("path", -2), "dst": F.element_at("path", -1)})
    return ends.join(names, ["src", "dst"], "left").select("path", "depth", F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"))


def dependency_trace(corpus: Corpus, path: str, direction: str = "both", max_depth: int = 3, unused: bool = True) -> dict[str, DataFrame]:
    """Chains forward (with the symbols of their last import) and backward, cycles, unused imports and exports of a file,
    and the number of files in chains."""
    edges = corpus.edges("trace")
    out = {}
    if direction in ("forward", "both"):
        out["forward"] = _with_symbols(corpus, graph.chains(edges, path, max_depth))
    if direction in ("backward", "both"):
        out["backward"] = graph.chains(graph.reverse(edges), path, max_depth).withColumn("symbols", F.array().cast("array<string>"))
    every = None
    for chains in out.values():
        chains = chains.select("path")
        every = chains if every is None else every.unionByName(chains)
    out["summary"] = every.select(F.explode("path").alias("file")).agg(F.countDistinct("file").alias("n_files"))
    out["cycles"] = graph.cycles(edges, path)
    if unused:
        out["unused"] = findings.unused_by_reference(corpus.files, path)
    return out


def find_dead_code(corpus: Corpus, entries: list[str]) -> dict[str, DataFrame]:
    seeds = corpus.files.sparkSession.createDataFrame([(e,) for e in entries], "node string")
    reached = graph.reachable(corpus.edges("dead_code"), seeds).select("node")
    found = findings.dead_code(corpus.files, reached, seeds, corpus.mode)
    kind = lambda x, text: F.when(F.count_if(F.col("type") == x) > 0, F.concat(F.count_if(F.col("type") == x), F.lit(text)))
    said = found.agg(
        _array(
            kind("unused-import", " imports are not used; remove them."),
            kind("unused-export", " exports or files are not used; look at them."),
            F.when(F.count_if(F.col("confidence") == "high") > 0, F.concat(F.count_if(F.col("confidence") == "high"), F.lit(" findings are certain; begin with them."))),
            F.when(F.count(F.lit(1)) == 0, F.lit("Nothing is unused.")),
        ).alias("recommendations")
    )
    return {"findings": found, "summary": findings.dead_code_summary(found), "safe": findings.safe_to_remove(found), "top": findings.top_files(found), "recommendations": said}


def coverage(files: DataFrame, target: str | None = None, threshold: float | None = None) -> dict[str, DataFrame]:
    """``files`` from a coverage report."""
    chosen = files if target is None else cov.below(files, target)
    return {"files": chosen, "summary": cov.overall(chosen, threshold), "lowest": cov.lowest(chosen), "recommendations": cov.recommendations(chosen, threshold)}


def test_ratio(corpus: Corpus) -> DataFrame:
    counts = source.test_counts(corpus.files)
    ratio = scores.ratio(F.col("n_tests"), F.col("n_sources"))
    return counts.withColumns({"ratio": ratio, "label": scores.ratio_label(ratio)})


def preview(corpus: Corpus, changes: DataFrame) -> dict[str, DataFrame]:
    rows = diffs.diffs(changes, corpus.files)
    return {"diffs": rows, "summary": diffs.summary(rows)}


def rename(corpus: Corpus, path: str, name: str, new: str, scope: str = "project", indexed: bool = False) -> dict[str, DataFrame]:
    """``indexed``: only files that the corpus's index of names has for ``name`` are scanned; the first call builds it."""
    rows = refactor.rename(corpus.naming(name) if indexed else corpus.files, path, name, new, scope)
    return {"symbol": refactor.find_symbol(corpus.files, path, name), "references": rows, "summary": refactor.rename_summary(rows), "preview": refactor.rename_preview(rows)}


def extract(corpus: Corpus, path: str, first: int, last: int, name: str, kind: str = "function") -> DataFrame:
    return refactor.extract(corpus.files, path, first, last, name, kind)


def type_abstraction(corpus: Corpus) -> dict[str, DataFrame]:
    """The definitions to take out and the change table that would do it."""
    found = types.abstractions(corpus.files)
    return {"found": found, "changes": types.source_changes(corpus.files, found).unionByName(types.type_files(found))}


def suggestions(replies: DataFrame, file: str = "", most: int = 5) -> DataFrame:
    return reports.suggestions(replies, file=file, most=most)


def validation(logs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Errors of tools' logs (kind to lines) and their counts by type."""
    rows = None
    for kind, lines in logs.items():
        one = reports.log_errors(lines, kind)
        rows = one if rows is None else rows.unionByName(one)
    return {"errors": rows, "counts": rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"))}


def project_health(corpus: Corpus, mode: str | None = None) -> DataFrame:
    """One row: files, total_lines (bytes in reference mode), complexity, test coverage, opportunities and the score."""
    files = corpus.files
    mode = mode or corpus.mode
    size = F.sum("size") if mode == "reference" else F.sum("n_lines")
    kinds = corpus.symbols.groupBy("path").agg(F.bool_or(F.col("type").isin("function", "class")).alias("code"), F.bool_or(F.col("type").isin("interface", "type")).alias("types"))
    sources = F.count_if(~F.col("is_test"))
    one = files.join(kinds, "path", "left").agg(
        F.count(F.lit(1)).alias("n_files"), F.coalesce(size, F.lit(0)).alias("total_lines"), F.coalesce(F.avg("complexity"), F.lit(0.0)).alias("average_complexity"),
        scores.percentage(F.count_if("is_test"), sources).alias("test_coverage"), F.count_if(F.col("code") & F.col("types")).alias("type_abstractions"),
    )
    one = one.withColumns({"complex_functions": F.lit(0), "duplicate_code": F.lit(0)})  # symbols carry no complexity
    total = F.col("type_abstractions") + F.col("complex_functions") + F.col("duplicate_code")
    one = one.withColumn("score", scores.health(F.col("average_complexity"), F.col("test_coverage"), total))
    said = _array(
        F.when(F.col("test_coverage") < 50, F.concat(F.lit("Add tests: coverage is "), scores.shown(F.col("test_coverage")), F.lit("%."))),
        F.when(F.col("average_complexity") > 10, F.concat(F.lit("Reduce complexity: on average it is "), scores.shown(F.col("average_complexity")), F.lit("."))),
        F.when(F.col("type_abstractions") > 0, F.concat("type_abstractions", F.lit(" files hold types that could move out."))),
        F.when(F.col("complex_functions") > 10, F.concat("complex_functions", F.lit(" functions branch too much; take them apart."))),
    )
    return one.withColumn("recommendations", _or_good(said, "The project is in good health."))


def language_gate(files: DataFrame, languages: tuple[str, ...] = source.LANGUAGES) -> DataFrame:
    return files.filter(F.col("language").isin(*languages))


def exported_names(corpus: Corpus) -> DataFrame:
    """path and its exported names in order of place."""
    rows = corpus.symbols.filter("is_exported").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "name"))).alias("s"))
    return rows.select("path", F.transform("s", lambda x: x["name"]).alias("names"))


def line_slice(corpus: Corpus, path: str, first: int, last: int) -> DataFrame:
    return corpus.files.filter(F.col("path") == path).select(fx.line_range(F.col("content"), F.lit(first), F.lit(last)).alias("text"))
