"""Columns over source text and paths.

Semantics follow JavaScript where they differ from Java's: white space that ``trim`` removes, and word boundaries and
identifiers that are ASCII.  A null text or path gives null unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: what JavaScript's trim() and \s take for white space.
BLANKS = "\t\n\x0b\f\r \xa0                　﻿"
_S = r"[\s\xa0  -     　﻿]"
_START, _END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

#: Fixed: language by extension.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".go": "go", ".java": "java",
    ".cpp": "cpp", ".c": "c", ".cs": "csharp", ".php": "php", ".rb": "ruby", ".rs": "rust",
}
#: Fixed: substrings that add one to a line's complexity, in two groups.
FLOW_WORDS = ("if", "else", "for", "while", "switch", "case", "catch", "try")
FUNCTION_WORDS = ("function", "=>", "def ", "func ")
#: Fixed: decision points of a function, each match one more.
DECISIONS = (
    rf"{_START}if{_S}*\(", rf"{_START}else{_S}+if{_S}*\(", rf"{_START}(?:for|while|do){_S}*\(", rf"{_START}case{_S}+",
    rf"{_START}catch{_S}*\(", r"\?[^:]*:", r"&&|\|\|",
)

#: Fixed patterns of imports: one-line script imports, Python imports, Go import sections and the names in them.
SCRIPT_IMPORT = rf"import{_S}+.*?{_S}+from{_S}+['\"]([^'\"]+)['\"]"
PYTHON_IMPORT = r"(?m)^\s*(?:from\s+([^\s]+)\s+)?import\s+([^\s,]+)"
GO_SECTION, QUOTED = r"import\s*\([\s\S]*?\)|import\s+['\"][^'\"]+['\"]", r"['\"]([^'\"]+)['\"]"
#: Fixed: names of files that hold types alone.
TYPE_FILES = r"(?:^|/)(?:[^/]*\.types\.tsx?|[^/]*\.d\.ts|types\.tsx?)$"


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def lines(text: Column) -> Column:
    """An empty text is one empty line."""
    return F.split(text, "\n")


def n_lines(text: Column) -> Column:
    return F.size(lines(text))


def line_range(text: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last`` (from 1, inclusive) joined again; empty where the range is."""
    return F.array_join(F.slice(lines(text), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def file_complexity(text: Column) -> Column:
    """For each line, 1 if it holds a control-flow word and 1 if it holds a function word, anywhere in it."""
    flow, function = "|".join(FLOW_WORDS), "|".join(FUNCTION_WORDS)
    flags = F.transform(lines(text), lambda x: trim(x).rlike(flow).cast("int") + trim(x).rlike(function).cast("int"))
    return F.aggregate(flags, F.lit(0), lambda a, b: a + b)


def function_complexity(text: Column) -> Column:
    """1 and the decision points; an ``else if`` counts as both."""
    total = F.lit(1)
    for pattern in DECISIONS:
        total = total + F.regexp_count(text, F.lit(pattern))
    return total


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(extension(path))), F.lit("other"))


def is_test(path: Column) -> Column:
    """Whether the name or any folder holds ``test`` or ``spec``."""
    return F.lower(path).contains("test") | F.lower(path).contains("spec")


def is_type_only(path: Column) -> Column:
    return path.rlike(TYPE_FILES)


def is_script(language_: Column) -> Column:
    return language_.isin("typescript", "javascript")


def is_relative(specifier: Column, absolute: bool = False) -> Column:
    """Whether a specifier names a file: starts with a dot (or, if ``absolute``, a slash)."""
    return specifier.startswith(".") | (specifier.startswith("/") if absolute else F.lit(False))


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def normalize(path: Column) -> Column:
    """Without ``.``, ``..`` and doubled slashes; a ``..`` above an absolute root goes."""
    absolute = path.startswith("/")

    def step(acc: Column, part: Column) -> Column:
        up = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1) != "..")
        shorter = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        higher = F.when(up, shorter).when(absolute, acc).otherwise(F.concat(acc, F.array(part)))
        return F.when(part.isin("", "."), acc).when(part == "..", higher).otherwise(F.concat(acc, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))


def join_path(folder: Column, specifier: Column) -> Column:
    return normalize(F.when(specifier.startswith("/"), specifier).otherwise(F.concat(folder, F.lit("/"), specifier)))


def relative_path(path: Column, folder: Column) -> Column:
    """``path`` as seen from ``folder``, both normalised."""
    a, b = F.filter(F.split(folder, "/"), lambda x: ~x.isin("", ".")), F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    flags = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))), lambda i: F.get(a, i - 1).eqNullSafe(F.get(b, i - 1)) & (i <= F.size(a)))
    same = F.aggregate(flags, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & x, 1).otherwise(0)).alias("n"), (s["on"] & x).alias("on")), lambda s: s["n"])
    ups = F.array_repeat(F.lit(".."), F.greatest(F.size(a) - same, F.lit(0)))
    return F.array_join(F.concat(ups, F.slice(b, same + 1, F.greatest(F.size(b) - same, F.lit(0)))), "/")


def proximity(folder: Column, candidate: Column) -> Column:
    """0 in the same folder, the depth below it, or 100 for each step up."""
    seen = relative_path(dirname(candidate), folder)
    ups = F.regexp_count(seen, F.lit(r"\.\."))
    return F.when(seen == "", 0).when(seen.startswith(".."), ups * 100).otherwise(F.size(F.split(seen, "/")))


def js_imports(text: Column) -> Column:
    """Specifiers of one-line ``import … from`` statements, in order, repeats kept."""
    return F.regexp_extract_all(text, F.lit(SCRIPT_IMPORT), 1)


def python_imports(text: Column) -> Column:
    """The module of ``from … import``, or the first name of ``import``."""
    pattern = F.lit(PYTHON_IMPORT)
    both = F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("a"), F.regexp_extract_all(text, pattern, 2).alias("b"))
    return F.transform(both, lambda x: F.when(x["a"] != "", x["a"]).otherwise(x["b"]))


def go_imports(text: Column) -> Column:
    """Quoted names in import blocks and single imports."""
    sections = F.regexp_extract_all(text, F.lit(GO_SECTION), 0)
    return F.flatten(F.transform(sections, lambda s: F.regexp_extract_all(s, F.lit(QUOTED), 1)))


def imports(text: Column, language_: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(is_script(language_), js_imports(text)).when(language_ == "python", python_imports(text)).when(language_ == "go", go_imports(text)).otherwise(none)


def type_references(text: Column) -> Column:
    """Distinct capitalised ASCII names."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"{_START}([A-Z][A-Za-z0-9_]*){_END}"), 1))


def free_names(used: Column, declared: Column, built_in: Column) -> Column:
    """Names used, neither declared nor built in, sorted."""
    return F.array_sort(F.array_except(F.array_except(F.array_distinct(used), declared), built_in))
