"""Previews of renaming a symbol and of extracting lines into a function; nothing is applied."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from .scripts import BUILT_IN, blanked, identifiers, parsed

#: Fixed: which declaration of a name is meant, first wins.
PRIORITY = ("function", "class", "interface", "type", "enum", "variable")


def find_symbol(files: DataFrame, path: str, name: str) -> DataFrame:
    """The declaration of ``name`` in a file by kind, else its first identifier; one row (line, kind) or none."""
    one = parsed(files.filter(F.col("path") == path), ("symbols", "identifiers"), "corrected")
    kind = F.array_position(F.array(*[F.lit(k) for k in PRIORITY]), F.col("s.type"))
    declared = one.select(F.explode("symbols").alias("s")).filter(F.col("s.name") == name).select(F.col("s.start_line").alias("line"), F.col("s.type").alias("kind"), kind.alias("rank"))
    named = one.select(F.explode("identifiers").alias("i")).filter(F.col("i.name") == name).select(F.col("i.line").alias("line"), F.lit("identifier").alias("kind"), F.lit(99).cast("bigint").alias("rank"))
    return declared.unionByName(named).orderBy("rank", "line").limit(1).select("line", "kind")


def rename(files: DataFrame, path: str, name: str, new: str, scope: str = "project") -> DataFrame:
    """path, line and text (after the change) of each reference, spelled as a whole word; a line for each of them."""
    chosen = files.filter(F.col("path") == path) if scope == "file" else files
    rows = parsed(chosen, ("identifiers",)).select("path", F.explode("identifiers").alias("i")).filter(F.col("i.name") == name)
    content = chosen.select("path", fx.lines(F.col("content")).alias("lines"))
    whole = rf"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])"
    changed = F.regexp_replace(F.get("lines", F.col("i.line") - 1), F.lit(whole), F.lit(new.replace("\\", "\\\\").replace("$", "\\$")))
    return rows.join(content, "path").select("path", F.col("i.line").alias("line"), changed.alias("text"))


def rename_summary(references: DataFrame) -> DataFrame:
    return references.groupBy("path").agg(F.count(F.lit(1)).alias("n")).orderBy("path")


def rename_preview(references: DataFrame, each: int = 5) -> DataFrame:
    """The first changes of each file, in order of lines."""
    return references.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("line", "text"))).filter(F.col("r") <= each).drop("r")


_DECLARES = re.compile(r"\b(?:const|let|var)\s+([^=;\n]+?)(?=\s+(?:of|in)\s|\s*[=;\n]|$)")


def free_names(code: str) -> list[str]:
    """Names that a stretch of code uses and doesn't declare, built-in ones left out, sorted.

    Names behind a dot count as used, as any identifier does.
    """
    clean, _ = blanked(code)
    declared = {n for m in _DECLARES.finditer(clean) for n in re.findall(r"[A-Za-z_$][\w$]*", m[1])}
    return sorted({i["name"] for i in identifiers(code)} - declared - set(BUILT_IN))


def extraction(content: str, first: int, last: int, name: str, kind: str = "function") -> dict:
    """The preview of extracting lines ``first`` to ``last`` (from 1) into ``name``."""
    lines = content.split("\n")
    code = "\n".join(lines[first - 1 : last])
    clean, _ = blanked(code)
    parameters = free_names(code)
    value, returns = None, "void"
    ends = [x for x in re.split(r"[;\n]", clean) if x.strip()]
    tail = ends[-1].strip() if ends else ""
    if tail.startswith("return ") or tail.startswith("return("):
        start = code.rfind("return") + 6
        value, returns = code[start:].strip().rstrip(";").strip() or None, "any"
    elif m := re.fullmatch(r"([A-Za-z_$][\w$]*)\s*(?:[-+*/%&|^]|\*\*|<<|>>>?|&&|\|\||\?\?)?=(?![=>]).*", tail, re.S):
        if any(i["name"] == m[1] for i in identifiers("\n".join(lines[last:]))):
            value, returns = m[1], "any"
    typed = ", ".join(f"{p}: any" for p in parameters)
    head = f"{name}({typed})" + (f": {returns}" if returns != "void" else "")
    call = f"{name}({', '.join(parameters)})"
    return {
        "code": code, "parameters": parameters, "return_type": returns, "return_variable": value,
        "signature": f"{head} {{\n{code}\n}}" if kind == "method" else f"function {head} {{\n{code}\n}}",
        "call": f"const {value} = {call};" if value else f"{call};",
    }


def extract(files: DataFrame, path: str, first: int, last: int, name: str, kind: str = "function") -> DataFrame:
    """code, parameters, return_type, return_variable, signature and call; one row."""
    ddl = "code string, parameters array<string>, return_type string, return_variable string, signature string, call string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [extraction(c, first, last, name, kind) for c in batch.column(0).to_pylist()]
            kinds = [pa.string(), pa.list_(pa.string()), *[pa.string()] * 4]
            names = ["code", "parameters", "return_type", "return_variable", "signature", "call"]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds, strict=True)], names)

    return files.filter(F.col("path") == path).select("content").mapInArrow(run, ddl)
