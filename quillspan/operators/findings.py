"""Rule-based opportunities and dead code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..storage import durable
from .ranking import numbered
from .scripts import parsed

#: Fixed: (medium above, high above) by rule.
THRESHOLDS = {"file-too-large": (300, 500), "function-too-long": (50, 100), "function-too-complex": (10, 20), "class-too-large": (15, 25)}
_UNITS = {"file-too-large": "lines", "function-too-long": "lines", "function-too-complex": "complexity", "class-too-large": "methods"}
#: Effort and impact at (high, medium).
_WEIGHT = {
    "file-too-large": (("high", "high"), ("medium", "medium")),
    "function-too-long": (("medium", "high"), ("low", "medium")),
    "function-too-complex": (("medium", "high"), ("low", "medium")),
    "class-too-large": (("high", "high"), ("medium", "medium")),
}
_ADVICE = {
    "file-too-large": "Split the file along the groups of declarations that belong together.",
    "function-too-long": "Take steps of the function out into helpers with one purpose each.",
    "function-too-complex": "Return early and name compound conditions to have fewer branches.",
    "class-too-large": "Give groups of methods that work on the same state a class of their own.",
}


def _judged(rule: str, current: Column) -> Column:
    """An opportunity struct, or null below the thresholds."""
    medium, high = THRESHOLDS[rule]
    (high_effort, high_impact), (low_effort, low_impact) = _WEIGHT[rule]
    severe = current > high
    fields = {
        "type": F.lit(rule),
        "severity": F.when(severe, "high").otherwise("medium"),
        "current": current.cast("int"),
        "threshold": F.lit(medium),
        "unit": F.lit(_UNITS[rule]),
        "suggestion": F.lit(_ADVICE[rule]),
        "effort": F.when(severe, high_effort).otherwise(low_effort),
        "impact": F.when(severe, high_impact).otherwise(low_impact),
    }
    return F.when(current > medium, F.struct(*[v.alias(k) for k, v in fields.items()]))


def methods_in_classes(symbols: DataFrame) -> DataFrame:
    """path, name, start_line and end_line of classes with n_methods: functions inside of them, in the same file."""
    classes = symbols.filter("type = 'class'").select("path", "name", "start_line", "end_line")
    functions = symbols.filter("type = 'function'").select(F.col("path").alias("p"), F.col("start_line").alias("a"), F.col("end_line").alias("z"))
    inside = (F.col("path") == F.col("p")) & (F.col("a") >= F.col("start_line")) & (F.col("z") <= F.col("end_line"))
    return classes.join(functions, inside, "left").groupBy("path", "name", "start_line", "end_line").agg(F.count("a").alias("n_methods"))


def opportunities(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Opportunities of script files, most severe first, then by impact, file and place, with ids in that order."""
    scripts = files.filter(fx.is_script(F.col("language")))
    none = F.lit(None).cast("int")
    whole = scripts.select("path", F.lit(0).alias("pos"), none.alias("start_line"), none.alias("end_line"), F.lit(None).cast("string").alias("symbol"), F.array(_judged("file-too-large", F.col("n_lines"))).alias("found"))
    functions = symbols.filter("type = 'function'").join(scripts.select("path", "content"), "path")
    length = F.col("end_line") - F.col("start_line") + 1
    branches = fx.function_complexity(fx.line_range(F.col("content"), F.col("start_line"), F.col("end_line")))
    by_function = functions.select("path", F.lit(1).alias("pos"), "start_line", "end_line", F.col("name").alias("symbol"), F.array(_judged("function-too-long", length), _judged("function-too-complex", branches)).alias("found"))
    classes = methods_in_classes(symbols).join(scripts.select("path"), "path", "left_semi")
    by_class = classes.select("path", F.lit(2).alias("pos"), "start_line", "end_line", F.col("name").alias("symbol"), F.array(_judged("class-too-large", F.col("n_methods"))).alias("found"))
    rows = whole.unionByName(by_function).unionByName(by_class)
    rows = rows.select("path", "pos", "start_line", "end_line", "symbol", F.explode(F.filter("found", lambda x: x.isNotNull())).alias("o"))
    return _ordered(rows.select("path", "pos", "start_line", "end_line", "symbol", "o.*"))


def rank(level: Column) -> Column:
    return F.when(level == "high", 0).when(level == "medium", 1).otherwise(2)


def _ordered(rows: DataFrame) -> DataFrame:
    order = [rank(F.col("severity")), rank(F.col("impact")), F.col("path"), F.col("pos"), F.col("start_line"), F.col("type")]
    return numbered(rows, order, "n").withColumn("id", F.concat(F.lit("opp-"), "n")).orderBy("n").drop("n")


def severity_summary(rows: DataFrame) -> DataFrame:
    level = lambda x: F.count_if(F.col("severity") == x).alias(x)
    return rows.agg(F.count(F.lit(1)).alias("total"), level("high"), level("medium"), level("low"))


def _finding(rows: DataFrame, kind: str, severity: str, description: Column, suggestion: str) -> DataFrame:
    return rows.select("path", F.col("line").cast("int").alias("line"), F.col("name").alias("symbol"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"), description.alias("description"), F.lit(suggestion).alias("suggestion"), F.lit("high").alias("confidence"))


def dead_code(files: DataFrame, reached: DataFrame, entries: DataFrame, mode: str = "reference") -> DataFrame:
    """Files that nothing reaches, exports that nothing names, imports that their file doesn't use.

    ``reached`` and ``entries`` have a column node; ids follow severity, path and line.  reference: any identifier of a reached file counts as a use of
    all exports of that name; corrected: only imports of other files do.
    """
    every = durable(parsed(files, ("exports", "imported", "identifiers"), mode), "parsed")  # read on several branches
    exports = every.select("path", F.explode("exports").alias("e")).select("path", "e.*")
    near = every.join(reached.select(F.col("node").alias("path")), "path", "left_semi")
    named = near.select("path", F.explode("imported").alias("i")).select("path", "i.*")
    used = named.select("name")
    if mode == "reference":
        used = used.union(near.select(F.explode("identifiers.name")))
    used = used.distinct()
    apart = exports.join(entries.select(F.col("node").alias("path")), "path", "left_anti")
    lost = apart.join(reached.select(F.col("node").alias("path")), "path", "left_anti").select("path").distinct()
    unreached = lost.select("path", F.lit(1).alias("line"), F.lit(None).cast("string").alias("name"))
    idle = apart.join(reached.select(F.col("node").alias("path")), "path", "left_semi").join(used, "name", "left_anti")
    uses = near.select("path", F.explode("identifiers.name").alias("name")).groupBy("path", "name").agg(F.count(F.lit(1)).alias("n"))
    own = named.filter("kind = 'named'").groupBy("path", "name").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("k"))
    unused = own.join(uses, ["path", "name"], "left").filter("coalesce(n, 0) <= k")
    found = (
        _finding(unreached, "unused-export", "high", F.lit("nothing that is reached imports this file"), "Remove the file if it is not needed.")
        .unionByName(_finding(idle, "unused-export", "medium", F.concat(F.lit("nothing uses the export "), F.col("name")), "Keep it private or remove it."))
        .unionByName(_finding(unused, "unused-import", "low", F.concat(F.lit("the file does not use its import "), F.col("name")), "Remove the import."))
    )
    order = [rank(F.col("severity")), F.col("path"), F.col("line"), F.col("symbol")]
    return numbered(found, order, "n").withColumn("id", F.concat(F.lit("finding-"), "n")).drop("n")


def dead_code_summary(findings: DataFrame) -> DataFrame:
    """One row: total, by confidence and by type."""
    kinds = ("unused-export", "unused-import", "unreachable-code", "unused-function", "unused-variable")
    count = lambda c, x: F.count_if(F.col(c) == x).alias(x.replace("-", "_"))
    return findings.agg(F.count(F.lit(1)).alias("total"), *[count("confidence", x) for x in ("high", "medium", "low")], *[count("type", x) for x in kinds])


def safe_to_remove(findings: DataFrame, most: int = 20) -> DataFrame:
    """``file:line (symbol)`` of findings with high confidence."""
    name = F.concat("path", F.lit(":"), "line", F.when(F.col("symbol").isNotNull(), F.concat(F.lit(" ("), "symbol", F.lit(")"))).otherwise(""))
    return findings.filter("confidence = 'high'").orderBy("path", "line", "symbol").select(name.alias("item")).limit(most)


def top_files(findings: DataFrame, files: int = 20, each: int = 10) -> DataFrame:
    """The files with most findings, and the first findings of each."""
    counts = findings.groupBy("path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "path").limit(files)
    ranked = findings.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("line", "type", "symbol")))
    return ranked.filter(F.col("r") <= each).join(counts, "path").orderBy(F.desc("n"), "path", "r")


def reference_counts(files: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """path and n of identifiers spelled ``name``, in one file or all."""
    rows = parsed(files if path is None else files.filter(F.col("path") == path), ("identifiers",))
    spelled = F.size(F.filter("identifiers", lambda x: x["name"] == name))
    return rows.select("path", spelled.alias("n")).filter("n > 0")


def unused_by_reference(files: DataFrame, path: str) -> DataFrame:
    """kind and name: imports of ``path`` referred to at most once there, exports referred to nowhere else."""
    rows = durable(parsed(files, ("exports", "imported", "identifiers")), "parsed")
    own = rows.filter(F.col("path") == path)
    spelled = own.select(F.explode("identifiers.name").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    idle = own.select(F.explode("imported.name").alias("name")).distinct().join(spelled, "name", "left").filter("coalesce(n, 0) <= 1")
    others = rows.filter(F.col("path") != path).select(F.explode("identifiers.name").alias("name")).distinct()
    unseen = own.select(F.explode("exports.name").alias("name")).distinct().join(others, "name", "left_anti")
    return idle.select(F.lit("import").alias("kind"), "name").unionByName(unseen.select(F.lit("export").alias("kind"), "name"))
