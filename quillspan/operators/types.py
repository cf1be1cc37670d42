"""Type definitions taken out of large files: finding them, their spans, the rewritten sources, imports between them.

Everything is returned as change tables; nothing is written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx

#: Fixed: lines from which definitions are taken out, and the patterns of definitions.
LARGE = 100
_INTERFACE = re.compile(r"interface\s+([A-Za-z_$][\w$]*)\s*\{", re.ASCII)
_ALIAS = re.compile(r"type\s+([A-Za-z_$][\w$]*)\s*=", re.ASCII)
_AUGMENTS = re.compile(r"declare\s+module\s+['\"`]")
_FUNCTION = re.compile(r"\bfunction\b", re.ASCII)


def _last(pattern: re.Pattern, line: str) -> str | None:
    """The name in the last match of a line, as a greedy prefix finds it."""
    found = pattern.findall(line)
    return found[-1] if found else None


def definitions(content: str) -> list[tuple[str, str, int, int]]:
    """(name, text, first line, last line) of interfaces without bases and aliases, lines from 0.

    Not in comments' lines, nor in blocks that augment the global scope or a module.
    """
    lines = content.split("\n")
    out: list[tuple[str, str, int, int]] = []
    depth: int | None = None  # inside a block that augments
    for k, raw in enumerate(lines):
        line = raw.strip(fx.BLANKS)
        if not line or line.startswith(("//", "/*", "*")):
            continue
        if "declare global" in line or _AUGMENTS.search(line):
            depth = 0
        if depth is not None:
            depth += line.count("{") - line.count("}")
            if depth == 0 and "}" in line:
                depth = None
            continue
        if _FUNCTION.search(line):
            continue
        for name in (_last(_INTERFACE, line), _last(_ALIAS, line)):
            if name:
                end = span_end(lines, k)
                body = "\n".join(lines[k : end + 1]).strip(fx.BLANKS)
                out.append((name, body if body.startswith("export ") else "export " + body, k, end))
    return out


def span_end(lines: list[str], start: int) -> int:
    """The line where braces outside of quotes are balanced again, or, before any brace, a line that ends with a semicolon."""
    depth, opened, quote = 0, False, ""
    for k in range(start, len(lines)):
        before = ""
        for c in lines[k]:
            if not quote and c in "\"'`":
                quote = c
            elif quote and c == quote and before != "\\":
                quote = ""
            if not quote:
                depth += (c == "{") - (c == "}")
                opened |= c == "{"
            before = c
        if depth == 0 if opened else lines[k].strip(fx.BLANKS).endswith(";"):
            return k
    return len(lines) - 1


_FOUND = "type_name string, type_content string, start_line int, end_line int"


def abstractions(files: DataFrame, large: int = LARGE) -> DataFrame:
    """type_name, source_file, target_file, type_content, is_centralized, import_statement, start_line and end_line of
    the definitions in script files of ``large`` lines or more that aren't for types alone.  None is centralized."""
    chosen = files.filter(fx.is_script(F.col("language")) & ~fx.is_type_only(F.col("path")) & (F.col("n_lines") >= large) & (F.col("content") != ""))
    arrow = pa.schema([("path", pa.string()), ("type_name", pa.string()), ("type_content", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *d) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for d in definitions(c)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    rows = chosen.select("path", "content").mapInArrow(run, "path string, " + _FOUND)
    target = F.concat(fx.dirname(F.col("path")), F.lit("/"), "type_name", F.lit(".types.ts"))
    statement = F.concat(F.lit("import { "), "type_name", F.lit(" } from './"), "type_name", F.lit(".types';"))
    return rows.select("type_name", F.col("path").alias("source_file"), target.alias("target_file"), "type_content", F.lit(False).alias("is_centralized"), statement.alias("import_statement"), "start_line", "end_line")


def insertion_line(lines: list[str]) -> int:
    """The line behind the last import of a file's head, imports over several lines included; 0 without one."""
    last, open_ = -1, False
    for k, raw in enumerate(lines):
        line = raw.strip(fx.BLANKS)
        if line.startswith(("import ", "import{")):
            last, open_ = k, ("}" not in line if "{" in line else open_)
        elif open_:
            last, open_ = k, "}" not in line
        elif last >= 0 and line and not line.startswith(("//", "/*")):
            break
    return last + 1


def rewritten(content: str, taken: list[tuple[str, str, int, int]]) -> str:
    """``content`` without the spans of ``taken`` (name, module, first, last), importing the types instead and passing
    on those that were exported."""
    lines = content.split("\n")
    at = insertion_line(lines)
    taken = sorted(taken, key=lambda t: -t[2])
    imports = [f"import type {{ {n} }} from '{m}';" for n, m, _, _ in taken]
    again = [f"export type {{ {n} }} from '{m}';" for n, m, a, _ in taken if lines[a].strip(fx.BLANKS).startswith("export ")]
    for _, _, a, z in taken:
        del lines[a : z + 1]
        if z < at:
            at -= z - a + 1
    return "\n".join([*lines[:at], *imports, *again, *lines[at:]])


def source_changes(files: DataFrame, found: DataFrame) -> DataFrame:
    """file_path, operation and new_content of the sources that definitions are taken from."""
    spans = found.groupBy("source_file").agg(F.collect_list(F.struct("type_name", F.concat(F.lit("./"), "type_name", F.lit(".types")), "start_line", "end_line")).alias("taken"))
    joined = files.join(spans, files["path"] == spans["source_file"]).select("path", "content", "taken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [rewritten(c, [tuple(t.values()) for t in taken]) for c, taken in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["update"] * len(new), pa.string()), pa.array(new, pa.string())], ["file_path", "operation", "new_content"])

    return joined.mapInArrow(run, "file_path string, operation string, new_content string")


def cross_imports(found: DataFrame) -> DataFrame:
    """target_file and statements: for each extracted type, imports of the other extracted types that it names, from
    the nearest file where several define one."""
    named = found.select("type_name", "target_file", F.explode(fx.type_references(F.col("type_content"))).alias("other")).filter("other != type_name")
    defined = found.select(F.col("type_name").alias("other"), F.col("target_file").alias("other_file"), F.row_number().over(Window.partitionBy("type_name").orderBy("target_file")).alias("k"))
    distance = fx.proximity(fx.dirname(F.col("target_file")), F.col("other_file"))
    nearest = named.join(defined, "other").groupBy("target_file", "type_name", "other").agg(F.min_by("other_file", F.struct(distance, F.col("k"))).alias("other_file"))
    seen = fx.relative_path(F.col("other_file"), fx.dirname(F.col("target_file")))
    module = F.regexp_replace(F.when(seen.startswith("."), seen).otherwise(F.concat(F.lit("./"), seen)), r"\.ts$", "")
    statement = F.concat(F.lit("import { "), "other", F.lit(" } from '"), module, F.lit("';"))
    return nearest.filter("other_file != target_file").groupBy("target_file").agg(F.array_sort(F.collect_list(statement)).alias("statements"))


def type_files(found: DataFrame) -> DataFrame:
    """file_path, operation and new_content of the files that hold the extracted types."""
    heads = cross_imports(found)
    head = F.when(F.col("statements").isNotNull(), F.concat(F.array_join("statements", "\n"), F.lit("\n\n"))).otherwise("")
    return found.join(heads, "target_file", "left").select(F.col("target_file").alias("file_path"), F.lit("create").alias("operation"), F.concat(head, "type_content").alias("new_content"))
