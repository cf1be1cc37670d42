"""Symbols and imports of a corpus as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from .scripts import parsed

#: Fixed patterns of trimmed lines that declare a symbol.
PYTHON_FUNCTION, PYTHON_CLASS = r"^(?:async\s+)?def\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", r"^class\s+([a-zA-Z_][a-zA-Z0-9_]*)"
GO_FUNCTION, GO_TYPE = r"^func\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", r"^type\s+([a-zA-Z_][a-zA-Z0-9_]*)"


def _numbered(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(fx.lines(F.col("content"))).alias("pos", "raw")).select("path", (F.col("pos") + 1).alias("line"), fx.trim(F.col("raw")).alias("text"))


def _row(name: Column, kind: str, exported: Column, private: Column) -> list[Column]:
    none = F.lit(None).cast("string")
    return [
        F.col("path"), name.alias("name"), F.lit(kind).alias("type"), F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.lit(0).alias("start_col"),
        F.length("text").alias("end_col"), exported.alias("is_exported"), private.alias("is_private"), F.lit(None).cast("array<string>").alias("parameters"), none.alias("return_type"), none.alias("documentation"),
    ]


def python_symbols(files: DataFrame) -> DataFrame:
    """Functions (methods too) and classes, by line; all exported, private with a leading underscore."""
    rows = _numbered(files)
    name_f, name_c = F.regexp_extract("text", PYTHON_FUNCTION, 1), F.regexp_extract("text", PYTHON_CLASS, 1)
    one = lambda name, kind: rows.filter(name != "").select(*_row(name, kind, F.lit(True), name.startswith("_")))
    return one(name_f, "function").unionByName(one(name_c, "class"))


def go_symbols(files: DataFrame) -> DataFrame:
    """Functions without receivers and types, by line; exported with a capital ASCII letter, private with a small one."""
    rows = _numbered(files)
    name_f, name_t = F.regexp_extract("text", GO_FUNCTION, 1), F.regexp_extract("text", GO_TYPE, 1)
    one = lambda name, kind: rows.filter(name != "").select(*_row(name, kind, name.rlike("^[A-Z]"), name.rlike("^[a-z]")))
    return one(name_f, "function").unionByName(one(name_t, "type"))


def script_symbols(files: DataFrame, mode: str = "reference") -> DataFrame:
    rows = parsed(files, ("symbols",), mode)
    return rows.select("path", F.explode("symbols").alias("s")).select("path", "s.*")


def symbols(files: DataFrame, mode: str = "reference") -> DataFrame:
    """Symbols of all languages that have an extractor."""
    python, go = files.filter("language = 'python'"), files.filter("language = 'go'")
    return script_symbols(files, mode).unionByName(python_symbols(python)).unionByName(go_symbols(go))


def imports(files: DataFrame) -> DataFrame:
    """path, ord and source of every import."""
    return files.select("path", F.posexplode(fx.imports(F.col("content"), F.col("language"))).alias("ord", "source"))


def with_symbols(files: DataFrame, mode: str = "reference") -> DataFrame:
    """``files`` with n_symbols and dependencies."""
    counts = symbols(files, mode).groupBy("path").agg(F.count(F.lit(1)).alias("n_symbols"))
    joined = files.join(counts, "path", "left").withColumn("n_symbols", F.coalesce("n_symbols", F.lit(0)))
    return joined.withColumn("dependencies", fx.imports(F.col("content"), F.col("language")))


def index_stats(files: DataFrame) -> DataFrame:
    """One row over files with n_symbols: n_files, n_symbols, n_tests, average_complexity (0 if none), total_size and a
    map of counts by language."""
    by = files.groupBy("language").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_symbols").alias("symbols"), F.count_if("is_test").alias("tests"), F.sum("complexity").alias("complexity"), F.sum("size").alias("size")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return by.agg(
        total("n").alias("n_files"), total("symbols").alias("n_symbols"), total("tests").alias("n_tests"), F.coalesce(F.try_divide(F.sum("complexity"), F.sum("n")), F.lit(0.0)).alias("average_complexity"),
        total("size").alias("total_size"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("by_language"),
    )


def complexity_summary(files: DataFrame, threshold: int = 10) -> DataFrame:
    """One row: average, maximum and the number of files above the threshold; ``complex_files`` names them."""
    above = F.count_if(F.col("complexity") > threshold).alias("n_above")
    return files.agg(F.coalesce(F.avg("complexity"), F.lit(0.0)).alias("average_complexity"), F.greatest(F.coalesce(F.max("complexity"), F.lit(0)), F.lit(0)).alias("max_complexity"), above)


def complex_files(files: DataFrame, threshold: int = 10) -> DataFrame:
    """relative_path and complexity of the files above the threshold."""
    return files.filter(F.col("complexity") > threshold).select("relative_path", "complexity")
