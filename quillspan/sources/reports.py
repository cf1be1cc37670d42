"""Reports of other tools as rows: coverage (JSON, text), test, lint and compiler logs, suggestions, change sets."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trim

_FILE = "struct<statementMap:map<string,struct<start:struct<line:int>>>,s:map<string,bigint>>"
#: Fixed patterns of lines: a coverage table, a linter's and a compiler's log.
COVERAGE_LINE = r"(.+?)\s+\|\s+([\d.]+)\s+\|\s+([\d.]+)\s+\|\s+([\d.]+)\s+\|\s+([\d.]+)"
LINT_LINE = r"(.+):(\d+):(\d+)\s+(error|warning)\s+(.+)"
COMPILER_LINE = r"(.+)\((\d+),(\d+)\):\s+error\s+TS\d+:\s+(.+)"
CHANGES = "file_path string, operation string, new_content string"


def coverage_json(reports: DataFrame, column: str = "value") -> DataFrame:
    """path, covered, total, pct, regions and missing of each file in reports (one JSON text a row).

    A report needs a ``coverageMap`` or a ``total`` at its top, else it has no rows; statements counted 0 and placed
    on a line are regions.
    """
    # the values of the outer map are parsed by themselves, as ``total`` has another shape
    outer = F.from_json(F.col(column), "map<string,string>")
    inner = F.from_json(F.element_at(outer, "coverageMap"), "map<string,string>")
    usable = F.coalesce(inner, F.when(F.map_contains_key(outer, "total"), outer))
    rows = reports.select(F.explode(usable).alias("path", "body")).filter("path != 'total'")
    rows = rows.select("path", F.from_json("body", _FILE).alias("f"))
    counts = F.coalesce(F.map_values("f.s"), F.array().cast("array<bigint>"))
    covered, total = F.size(F.filter(counts, lambda c: c > 0)), F.size(counts)
    missed = F.coalesce(F.map_keys(F.map_filter("f.s", lambda _, c: c == 0)), F.array().cast("array<string>"))
    line = lambda k: F.coalesce(F.element_at(F.col("f.statementMap"), k)["start"]["line"], F.lit(0))
    placed = F.array_sort(F.filter(F.transform(missed, line), lambda x: x > 0))
    regions = F.transform(placed, lambda x: F.struct(x.alias("start_line"), x.alias("end_line"), F.lit("statement").alias("type")))
    pct = F.coalesce(F.try_divide(covered * 100.0, total), F.lit(0.0))
    return rows.select("path", covered.alias("covered"), total.alias("total"), pct.alias("pct"), regions.alias("regions"), (F.size(placed) > 0).alias("missing"))


def coverage_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same from a table with bars; counts are not in it and are 0."""
    pattern = COVERAGE_LINE
    pct = F.regexp_extract(column, pattern, 2).try_cast("double")
    empty = F.array().cast("array<struct<start_line:int,end_line:int,type:string>>")
    rows = lines.filter(F.col(column).rlike(pattern))
    return rows.select(trim(F.regexp_extract(column, pattern, 1)).alias("path"), F.lit(0).alias("covered"), F.lit(0).alias("total"), pct.alias("pct"), empty.alias("regions"), (pct < 100).alias("missing"))


def _capped(found: DataFrame, fallback: str, kind: str, most: int = 10) -> DataFrame:
    """The first rows, or one row that says that something failed."""
    first = found.orderBy("n").limit(most)
    none = found.limit(1).agg(F.count(F.lit(1)).alias("any")).filter(F.col("any") == 0)
    rest = none.select(F.lit(-1).cast("bigint").alias("n"), F.lit(kind).alias("type"), F.lit(fallback).alias("message"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"))
    return first.unionByName(rest)


def log_errors(lines: DataFrame, kind: str, column: str = "value", order: str = "n", most: int = 10) -> DataFrame:
    """n, type, message, file and line from a tool's log; ``kind`` is test, lint or typescript.

    ``lines`` has one line a row with its number in ``order``.  At most ``most`` rows, or one fallback row.
    """
    x = F.col(column)
    n = F.col(order).cast("bigint").alias("n")
    if kind == "test":
        found = lines.filter(x.contains("FAIL") | x.contains("Error:"))
        rows = found.select(n, F.lit("test").alias("type"), trim(x).alias("message"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"))
        return _capped(rows, "tests failed", "test", most)
    if kind == "lint":
        pattern = LINT_LINE
        message, fallback = 5, "lint failed"
    elif kind == "typescript":
        pattern = COMPILER_LINE
        message, fallback = 4, "type check failed"
    else:
        raise ValueError(f"unknown kind of log: {kind}")
    get = lambda k: F.regexp_extract(x, pattern, k)
    rows = lines.filter(x.rlike(pattern)).select(n, F.lit(kind).alias("type"), get(message).alias("message"), get(1).alias("file"), get(2).try_cast("int").alias("line"))
    return _capped(rows, fallback, kind, most)


#: Fixed: what a risk score below each bound says of the impact, the last one for all above.
IMPACTS = ((20, "Low risk, minimal impact"), (50, "Medium risk, affects a few files"), (80, "High risk, affects many files"), (None, "Very high risk, requires careful review"))
_ITEM = "struct<type:string,title:string,description:string,startLine:bigint,endLine:bigint,riskScore:double,autoApplicable:boolean,reasoning:string,priority:string>"
_JSON = {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}


def suggestions(replies: DataFrame, column: str = "value", file: str = "", most: int = 5) -> DataFrame:
    """Suggestions in replies of a language model: a JSON object with an array ``suggestions``, in a json fence or bare.

    Fields that are missing or empty get defaults (a risk score or a line that is no number counts as missing); ids are
    by position.  Anything else, a bare array or a null suggestion too, gives one row, ``error-1``, with the reason.
    Other columns of ``replies`` are passed on.
    """
    fence = r"(?s)```json\s*(.*?)\s*```"
    body = trim(F.when(F.col(column).rlike(fence), F.regexp_extract(column, fence, 1)).otherwise(F.col(column)))
    whole = body.startswith("{") & body.endswith("}")
    raw = F.from_json(body, "struct<suggestions:array<string>>", _JSON)["suggestions"]
    parsed = F.from_json(body, f"struct<suggestions:array<{_ITEM}>>", _JSON)["suggestions"]
    good = whole & raw.isNotNull() & ~F.exists(raw, lambda x: x.isNull())
    reason = F.when(~F.coalesce(whole, F.lit(False)), "Error: the reply holds no JSON object").otherwise("Error: the reply holds no array of suggestions")
    rows = replies.withColumns({"__good": F.coalesce(good, F.lit(False)), "__reason": reason, "__all": F.slice(F.coalesce(parsed, F.array().cast(f"array<{_ITEM}>")), 1, most)})
    keys = [F.col(f"`{c}`") for c in replies.columns if c != column]
    some = rows.filter("__good").select(*keys, F.posexplode("__all").alias("__pos", "s"))
    text = lambda name, default: F.when(F.coalesce(F.col(f"s.{name}"), F.lit("")) == "", default).otherwise(F.col(f"s.{name}"))
    risk = F.when(F.coalesce(F.col("s.riskScore"), F.lit(0.0)) == 0, 50.0).otherwise(F.col("s.riskScore"))
    impact = F.lit(IMPACTS[-1][1])
    for bound, said in reversed(IMPACTS[:-1]):
        impact = F.when(risk < bound, said).otherwise(impact)
    line = lambda name: F.coalesce(F.col(f"s.{name}"), F.lit(0)).cast("int")
    found = some.select(
        *keys, F.concat(F.lit("suggestion-"), F.col("__pos") + 1).alias("id"), text("type", "unknown").alias("type"), text("title", "Untitled suggestion").alias("title"), text("description", "").alias("description"),
        F.lit(file).alias("file"), line("startLine").alias("start_line"), line("endLine").alias("end_line"), impact.alias("estimated_impact"), risk.alias("risk_score"),
        F.coalesce("s.autoApplicable", F.lit(False)).alias("auto_applicable"), text("reasoning", "").alias("reasoning"), text("priority", "medium").alias("priority"),
    )
    none = rows.filter("not __good").select(
        *keys, F.lit("error-1").alias("id"), F.lit("analysis-error").alias("type"), F.lit("Unable to parse suggestions").alias("title"), F.lit("The reply could not be read; ask again.").alias("description"),
        F.lit(file).alias("file"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit("Unknown").alias("estimated_impact"), F.lit(0.0).alias("risk_score"),
        F.lit(False).alias("auto_applicable"), F.col("__reason").alias("reasoning"), F.lit("low").alias("priority"),
    )
    return found.unionByName(none)


def changes(spark: SparkSession, rows: list[tuple[str, str, str | None]]) -> DataFrame:
    """A change set; operations other than update, create and delete are refused."""
    for _, operation, _ in rows:
        if operation not in ("update", "create", "delete"):
            raise ValueError(f"unknown operation: {operation}")
    return spark.createDataFrame(rows, CHANGES)


def top_rows(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


def commands(manifest: str) -> dict[str, list[str]]:
    """The commands that a package manifest (JSON text) offers for coverage, tests, lint and type checks.

    The first script that exists is taken for each; without one, and for a text that is no manifest, there is none.
    """
    try:
        scripts = json.loads(manifest).get("scripts") or {}
    except (ValueError, AttributeError):
        return {}
    wanted = {"coverage": ("test:coverage", "coverage"), "test": ("test",), "lint": ("lint",), "typescript": ("typecheck", "type-check")}
    found = {kind: next((n for n in names if n in scripts), None) for kind, names in wanted.items()}
    return {kind: ["npm", "run", name] for kind, name in found.items() if name}
