"""Reading JavaScript and TypeScript without a compiler: a scanner that blanks what is not code, then declarations.

``blanked`` replaces comments, strings, templates and regular expressions by blanks of the same length, so positions
stay and braces can be counted.  Declarations are then found at brace depth 0.  The grammar covered: functions,
classes, interfaces, type aliases, enums, variables (also destructured), named, default and namespace imports, export
lists and re-exports.  Decorators, JSX text with braces or quotes in it, and code built by ``eval`` are beyond it; of a
file with errors, what was found is returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_script

_NAME = r"[A-Za-z_$][\w$]*"
_WORDS_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}
_HEAD = re.compile(
    rf"(?:(export)\s+)?(?:(default)\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:(const)\s+(?=enum\b))?"
    rf"(function|class|interface|type|enum|namespace|module|const|let|var)\b\s*(\*)?\s*({_NAME})?"
)
#: Fixed: words that are not identifiers.
KEYWORDS = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null "
    "return super switch this throw true try typeof var void while with let static yield await async of as from type interface implements private public "
    "protected readonly declare abstract namespace module keyof infer is".split()
)
#: Fixed: names that extraction never turns into parameters.
BUILT_IN = (
    "console", "process", "window", "document", "Math", "Date", "JSON", "Array", "Object", "String", "Number", "Boolean", "undefined", "null",
    "true", "false", "this", "super", "require", "module", "exports", "__dirname", "__filename",
)


def blanked(code: str) -> tuple[str, bool]:
    """``code`` with everything that is not code blanked (line feeds stay), and whether it ended outside of such parts.

    Expressions inside templates stay.
    """
    out = list(code)
    i, n = 0, len(code)
    templates: list[int] = []  # open braces inside of each template expression
    ended, last = True, ""

    def blank(a: int, b: int) -> None:
        for k in range(a, b):
            if out[k] != "\n":
                out[k] = " "

    def template(a: int) -> int:
        """From behind a backtick or a closing brace to behind the template's end or the start of its next expression."""
        nonlocal ended
        k = a
        while k < n:
            if code[k] == "\\":
                k += 2
            elif code[k] == "`":
                blank(a, k + 1)
                return k + 1
            elif code.startswith("${", k):
                blank(a, k + 2)
                templates.append(0)
                return k + 2
            else:
                k += 1
        blank(a, n)
        ended = False
        return n

    while i < n:
        c = code[i]
        if code.startswith("//", i):
            j = code.find("\n", i)
            j = n if j < 0 else j
            blank(i, j)
            i = j
            continue
        if code.startswith("/*", i):
            j = code.find("*/", i + 2)
            ended, j = (ended, j + 2) if j >= 0 else (False, n)
            blank(i, j)
            i = j
            continue
        if c in "\"'":
            j = i + 1
            while j < n and code[j] != c and code[j] != "\n":
                j += 2 if code[j] == "\\" else 1
            j = min(j + 1, n)
            blank(i + 1, j - 1)
            i, last = j, c
            continue
        if c == "`":
            out[i] = " "
            i, last = template(i + 1), "`"
            continue
        if c == "/" and (last in "([{,;=:!&|?+-*%<>~^" or last in _WORDS_BEFORE_REGEX):
            j, inside = i + 1, False
            while j < n and code[j] != "\n" and (inside or code[j] != "/"):
                inside = True if code[j] == "[" else False if code[j] == "]" else inside
                j += 2 if code[j] == "\\" else 1
            if j < n and code[j] == "/":
                blank(i, j + 1)
                i, last = j + 1, "/r"
                continue
        if templates:
            if c == "{":
                templates[-1] += 1
            elif c == "}":
                if templates[-1] == 0:
                    templates.pop()
                    out[i] = " "
                    i = template(i + 1)
                    continue
                templates[-1] -= 1
        if c.isalnum() or c in "_$":
            m = re.compile(r"[\w$]+").match(code, i)
            last, i = m[0], m.end()
            continue
        if not c.isspace():
            last = c
        i += 1
    return "".join(out), ended and not templates


@dataclass
class Symbol:
    name: str
    type: str
    start: int
    end: int
    exported: bool
    parameters: list[str] | None = None
    returns: str | None = None
    documentation: str | None = None


def _closing(code: str, at: int) -> int:
    """Position behind the bracket that closes the one at ``at``, or the end."""
    depth = 0
    for k in range(at, len(code)):
        if code[k] in "([{":
            depth += 1
        elif code[k] in ")]}":
            depth -= 1
            if depth == 0:
                return k + 1
    return len(code)


def _end_of_statement(code: str, at: int) -> int:
    """Behind the statement that starts at ``at``: at a semicolon, or a line's end where all brackets are closed and
    the statement does not go on."""
    depth = 0
    for k in range(at, len(code)):
        c = code[k]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return k
        elif c == ";" and depth == 0:
            return k + 1
        elif c == "\n" and depth == 0:
            before, after = code[at:k].rstrip(), code[k:].lstrip()
            if before and before[-1] not in "=,+-*/&|?:<(.>{" and not (after and after[0] in ".?:&|+*,=)"):
                return k
            if before.endswith("=>") or not before:
                continue
    return len(code)


def _split_top(text: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for k, c in enumerate(text):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or c == ">" and (k == 0 or text[k - 1] != "="):
            depth -= 1
        elif c == "," and depth == 0:
            parts.append(text[start:k])
            start = k + 1
    return [p for p in [*parts, text[start:]] if p.strip()]


def _documentation(code: str, at: int) -> str:
    m = re.search(r"/\*\*((?:(?!\*/)[\s\S])*)\*/\s*$", code[:at])
    return "\n".join(x.strip().removeprefix("*").strip() for x in m[1].strip().split("\n")) if m else ""


def top_level(code: str) -> tuple[list[Symbol], bool]:
    """Declarations at depth 0 in order of place, and whether the whole text could be scanned."""
    clean, ended = blanked(code)
    found: list[Symbol] = []
    depth, k = 0, 0
    at_start = True
    while k < len(clean):
        c = clean[k]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            at_start = depth == 0 and c == "}"
            k += 1
            continue
        if depth == 0 and at_start and (c.isalpha() or c in "_$"):
            m = _HEAD.match(clean, k)
            if m and (m[6] or m[4] in ("function", "class", "const", "let", "var")):
                k = _declaration(code, clean, m, found)
                at_start = True
                continue
        if depth == 0 and not c.isspace():
            at_start = c == ";"
            if c.isalnum() or c in "_$":
                m2 = re.compile(r"[\w$]+").match(clean, k)
                at_start = m2[0] in ("export", "default")
                k = m2.end()
                continue
        elif depth == 0 and c == "\n":
            at_start = True
        k += 1
    return found, ended and depth == 0


def _declaration(code: str, clean: str, m: re.Match, found: list[Symbol]) -> int:
    kind, name, exported, start = m[4], m[6], bool(m[1]), m.start()
    note = _documentation(code, start)
    if kind == "function":
        bracket = clean.find("(", m.end())
        if bracket < 0:
            return m.end()
        close = _closing(clean, bracket)
        parameters = [re.sub(r"^(?:(?:public|private|protected|readonly)\s+)*(?:\.\.\.)?", "", p.strip()) for p in _split_top(clean[bracket + 1 : close - 1])]
        names = [re.match(r"[\w$]+|[{\[][^}\]]*[}\]]", p) for p in parameters]
        brace, semicolon = clean.find("{", close), clean.find(";", close)
        if brace < 0 or 0 <= semicolon < brace:
            end = semicolon + 1 if semicolon >= 0 else len(clean)
            returns = code[close : end - 1]
        else:
            head = clean[close:brace]
            if re.fullmatch(r"\s*:\s*", head):  # an object type
                brace = clean.find("{", _closing(clean, brace))
            returns, end = code[close:brace], _closing(clean, brace)
        returns = returns.strip().removeprefix(":").strip() or None
        found.append(Symbol(name, "function", start, end, exported, [x[0] for x in names if x], returns, note))
        return end
    if kind in ("class", "interface", "enum", "namespace", "module"):
        brace = clean.find("{", m.end())
        end = _closing(clean, brace) if brace >= 0 else len(clean)
        if kind in ("class", "interface", "enum"):
            found.append(Symbol(name or "AnonymousClass", kind, start, end, exported, documentation=note))
        return end
    end = _end_of_statement(clean, m.end())
    if kind == "type":
        if not re.match(r"\s*(?:<|=)", clean[m.end() :]):
            return m.end()
        found.append(Symbol(name, "type", start, end, exported, documentation=note))
        return end
    begin = m.start(6) if name else m.end()
    for part in _split_top(clean[begin:end].rstrip(";")):
        target = part.split("=")[0].strip()
        place = clean.find(part.strip(), begin)
        if target[:1] in "{[":
            bound = re.split(r"\s*=\s*", part.strip())[0]
            names = [x.split(":")[-1].split("=")[0].strip().removeprefix("...") for x in _split_top(bound.strip()[1:-1])]
        else:
            names = [re.match(_NAME, target)[0]] if re.match(_NAME, target) else []
        found += [Symbol(x, "variable", place, min(place + len(part.strip()), end), exported) for x in names if re.fullmatch(_NAME, x)]
    return end


def _line(code: str, at: int) -> int:
    return code.count("\n", 0, at) + 1


_ORDER = {"function": 0, "class": 1, "interface": 2, "type": 3, "variable": 4}


def symbol_rows(code: str, mode: str = "reference") -> list[dict]:
    """Rows of one file: functions, classes, interfaces, types, variables whose names do not start with ``_``.

    reference: nothing for a file with an unnamed default function.  corrected: the others of such a file, and enums.
    """
    found, _ = top_level(code)
    if mode == "reference" and any(s.name is None for s in found):
        return []
    exported = {x for x, _ in export_lists(code)}
    kinds = _ORDER if mode == "reference" else _ORDER | {"enum": 5}
    chosen = [s for s in found if s.name and s.type in kinds and not (s.type == "variable" and s.name.startswith("_"))]
    out = []
    for s in sorted(chosen, key=lambda s: (kinds[s.type], s.start)):
        start_pos = code.rfind("\n", 0, s.start) + 1
        out.append(
            {
                "name": s.name, "type": s.type, "start_line": _line(code, s.start), "end_line": _line(code, max(s.end - 1, s.start)), "start_col": start_pos, "end_col": s.end,
                "is_exported": s.exported or s.name in exported, "is_private": s.name.startswith("_"), "parameters": s.parameters, "return_type": s.returns, "documentation": s.documentation,
            }
        )
    return out


_EXPORT_LIST = re.compile(r"export\s+(?:type\s+)?\{([^}]*)\}")


def export_lists(code: str) -> list[tuple[str, str]]:
    """(own name, exported name) of export lists."""
    clean, _ = blanked(code)
    out = []
    for m in _EXPORT_LIST.finditer(clean):
        for part in m[1].split(","):
            names = re.findall(_NAME, re.sub(r"^\s*type\s+", "", part))
            if names:
                out.append((names[0], names[-1]))
    return out


def exported(code: str) -> list[dict]:
    """name and line of everything a file exports, re-exported names too."""
    found, _ = top_level(code)
    clean, _ = blanked(code)
    own = {s.name: s for s in found if s.name}
    out = [{"name": s.name, "line": _line(code, s.start)} for s in found if s.exported and s.name and not re.match(r"export\s+default\b", clean[s.start :])]
    for m in re.finditer(r"export\s+default\b", clean):
        out.append({"name": "default", "line": _line(code, m.start())})
    for m in _EXPORT_LIST.finditer(clean):
        for part in m[1].split(","):
            names = re.findall(_NAME, re.sub(r"^\s*type\s+", "", part))
            if names:
                line = _line(code, own[names[0]].start) if names[0] in own else _line(code, m.start())
                out.append({"name": names[-1], "line": line})
    return out


_IMPORT = re.compile(r"import\s+(?:type\s+)?([^;'\"]*?)\s*from\s*['\"]")


def imported(code: str) -> list[dict]:
    """name, kind (named, default, namespace), line, end_line and source (the specifier) of each imported name."""
    clean, _ = blanked(code)
    out = []
    for m in _IMPORT.finditer(clean):
        where = {"line": _line(code, m.start()), "end_line": _line(code, m.end()), "source": code[m.end() : code.find(code[m.end() - 1], m.end())]}
        body = m[1]
        for list_ in re.finditer(r"\{([^}]*)\}", body):
            for part in list_[1].split(","):
                names = re.findall(_NAME, re.sub(r"^\s*type\s+", "", part))
                if names:
                    out.append({"name": names[0], "kind": "named"} | where)
        rest = re.sub(r"\{[^}]*\}", "", body)
        for ns in re.finditer(rf"\*\s+as\s+({_NAME})", rest):
            out.append({"name": ns[1], "kind": "namespace"} | where)
        first = re.match(rf"\s*({_NAME})", re.sub(rf"\*\s+as\s+{_NAME}", "", rest))
        if first:
            out.append({"name": first[1], "kind": "default"} | where)
    return out


def identifiers(code: str) -> list[dict]:
    """name and line of every identifier in code (keywords are none)."""
    clean, _ = blanked(code)
    out, line, at = [], 1, 0
    for m in re.finditer(rf"(?<![\w$])(?:{_NAME})", clean):
        line += clean.count("\n", at, m.start())
        at = m.start()
        if m[0] not in KEYWORDS:
            out.append({"name": m[0], "line": line})
    return out


_SYMBOL = "array<struct<name:string,type:string,start_line:int,end_line:int,start_col:int,end_col:int,is_exported:boolean,is_private:boolean,parameters:array<string>,return_type:string,documentation:string>>"
SCHEMAS = {
    "symbols": _SYMBOL,
    "exports": "array<struct<name:string,line:int>>",
    "imported": "array<struct<name:string,kind:string,line:int,end_line:int,source:string>>",
    "identifiers": "array<struct<name:string,line:int>>",
}


def parsed(files: DataFrame, what: tuple[str, ...] = ("symbols", "exports", "imported", "identifiers"), mode: str = "reference") -> DataFrame:
    """path and one array column for each of ``what`` of every script file: one pass over contents, no shuffle."""
    from pyspark.sql.pandas.types import to_arrow_schema

    readers = {"symbols": lambda code: symbol_rows(code, mode), "exports": exported, "imported": imported, "identifiers": identifiers}
    ddl = "path string, " + ", ".join(f"{w} {SCHEMAS[w]}" for w in what)
    arrow = to_arrow_schema(files.sparkSession.createDataFrame([], ddl).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [c or "" for c in batch.column(1).to_pylist()]
            columns = [pa.array([readers[w](c) for c in codes], arrow.field(w).type) for w in what]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=arrow)

    return files.filter(is_script(F.col("language"))).select("path", "content").mapInArrow(run, ddl)
