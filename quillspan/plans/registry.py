"""All queries of the library, with SQL that says the same for each that SQL can express.

Names of operators in the survey are given after each query's name.  Table queries run over whole tables; queries about
code use the small corpus of ``samples``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions import text as fx
from ..operators import coverage as cov
from ..operators import diffs, findings, graph, reach, resolve, types
from ..operators import symbols as sym
from ..operators.scripts import BUILT_IN, KEYWORDS
from ..sources import corpus as source
from ..sources import reports
from ..storage import durable, fresh_path
from . import samples, tools
from .corpus import Corpus

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import derived, structures

    return _QUERIES | structures.queries() | derived.queries()


def oracle_sql() -> dict[str, str]:
    from . import derived, structures

    return _SQL | structures.oracle_sql() | derived.oracle_sql()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sample(spark: SparkSession, mode: str = "reference") -> Corpus:
    return Corpus(source.from_rows(spark, samples.FILES, samples.ROOT), mode)


_FILES = samples.values(samples.FILES, "path, content")
_LANG_SQL = "CASE lower(regexp_extract({0}, '[^/](\\.[^./]*)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fx.LANGUAGES.items()) + " ELSE 'other' END"
_TRIM = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"
_FLOW, _FUNC = "|".join(fx.FLOW_WORDS), "|".join(fx.FUNCTION_WORDS)
_COMPLEXITY = "coalesce(list_sum(list_transform(string_split({0}, chr(10)), lambda x: CAST(regexp_matches(" + _TRIM.format("x") + f", '{_FLOW}') AS INT) + CAST(regexp_matches(" + _TRIM.format("x") + f", '{_FUNC}') AS INT))), 0)"
_DOC = "SELECT *, CAST(" + _COMPLEXITY.format("text") + " AS INT) AS complexity, CAST(len(string_split(text, chr(10))) AS INT) AS n_lines FROM documents"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return d.withColumns({"complexity": fx.file_complexity(F.col("text")), "n_lines": fx.n_lines(F.col("text"))})


def _resolve_sql(rule: str, corrected: bool = False) -> str:
    """Over paths written out, as SQL has no path functions: candidates of each import of the sample."""
    endings, _ = resolve.RULES[rule]
    rows = []
    for src, ord_, spec, base in _sample_imports():
        tried = [base + e for e in endings] + ([base[: -len(".js")] + ".ts"] if corrected and base.endswith(".js") else [base] if corrected else [])
        rows += [(src, ord_, spec, k, t) for k, t in enumerate(tried)]
    folders = sorted({p[:k] for p, _ in samples.FILES for k in range(1, len(p)) if p[k] == "/"}) if rule in ("trace", "dead_code") else []
    listing = samples.values([p for p, _ in samples.FILES] + folders, "path")
    return f"SELECT src, ord, source, arg_min(dst, rank) AS dst FROM {samples.values(rows, 'src, ord, source, rank, dst')} c JOIN {listing} f ON c.dst = f.path GROUP BY src, ord, source"


def _sample_imports() -> list[tuple[str, int, str, str]]:
    import posixpath
    import re

    out = []
    for path, content in samples.FILES:
        if path.endswith((".ts", ".tsx", ".js")):
            for k, spec in enumerate(re.findall(r"import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]", content)):
                if spec.startswith("."):
                    out.append((path, k, spec, posixpath.normpath(posixpath.join(posixpath.dirname(path), spec))))
    return out


# The sample's code in SQL: its files hold no comments, templates or regular expressions, and strings in single quotes.
_CODE = f"""
files AS (SELECT * FROM {_FILES}),
lines AS (SELECT path, unnest(string_split(content, chr(10))) AS raw, CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INT) AS line FROM files WHERE regexp_matches(path, '[.](ts|tsx|js|jsx)$')),
clean AS (SELECT path, line, raw, regexp_replace(raw, '''[^'']*''', '''''', 'g') AS t FROM lines),
words AS (SELECT * FROM (SELECT path, line, unnest(regexp_extract_all(t, '[A-Za-z_$][A-Za-z0-9_$]*')) AS name FROM clean) WHERE name NOT IN ({', '.join(map(samples.quoted, sorted(KEYWORDS)))})),
named AS (
  SELECT path, line, 'named' AS kind, trim(unnest(string_split(regexp_extract(t, '^import\\s+(?:type\\s+)?\\{{([^}}]*)\\}}', 1), ','))) AS name FROM clean WHERE regexp_matches(t, '^import\\s+(?:type\\s+)?\\{{')
  UNION ALL SELECT path, line, 'default', regexp_extract(t, '^import\\s+([A-Za-z_$]+)\\s+from', 1) FROM clean WHERE regexp_matches(t, '^import\\s+[A-Za-z_$]+\\s+from')
  UNION ALL SELECT path, line, 'namespace', regexp_extract(t, '[*]\\s+as\\s+([A-Za-z_$]+)', 1) FROM clean WHERE regexp_matches(t, '^import\\s+[*]')
),
declared AS (
  SELECT path, line, t, regexp_extract(t, '^(?:export\\s+)?(?:default\\s+)?(?:async\\s+)?(function|class|interface|type|const|let|var)\\s', 1) AS word,
    regexp_extract(t, '^(?:export\\s+)?(?:default\\s+)?(?:async\\s+)?(?:function|class|interface|type|const|let|var)\\s+([A-Za-z_$][A-Za-z0-9_$]*)', 1) AS name, starts_with(t, 'export') AS is_exported
  FROM clean
),
exported AS (SELECT path, line, CASE WHEN regexp_matches(t, '^export\\s+default') THEN 'default' ELSE name END AS name FROM declared WHERE is_exported AND name <> '')
"""
_PY_NAMES, _GO_NAMES = r"^(?:async\s+)?(?:def|class)\s+([a-zA-Z_][a-zA-Z0-9_]*)", r"^(?:func|type)\s+([a-zA-Z_][a-zA-Z0-9_]*)"
_OTHERS = f"""
others AS (
  SELECT path, line, name, starts_with(name, '_') AS is_private, true AS is_exported FROM (SELECT path, line, regexp_extract(t, '{_PY_NAMES}', 1) AS name FROM (SELECT path, {_TRIM.format("unnest(string_split(content, chr(10)))")} AS t, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM files WHERE path LIKE '%.py')) WHERE name <> ''
  UNION ALL
  SELECT path, line, name, regexp_matches(name, '^[a-z]'), regexp_matches(name, '^[A-Z]') FROM (SELECT path, line, regexp_extract(t, '{_GO_NAMES}', 1) AS name FROM (SELECT path, {_TRIM.format("unnest(string_split(content, chr(10)))")} AS t, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM files WHERE path LIKE '%.go')) WHERE name <> ''
)
"""


def _graph_sql(rule: str, corrected: bool = False) -> str:
    """links: the edges of the sample by a rule."""
    return f"links AS (SELECT DISTINCT src, dst FROM ({_resolve_sql(rule, corrected)}) WHERE dst IN (SELECT path FROM files))"


# corpus statistics: A1, A2, P1, P2, P4, P10, M1, M3


@_query(f"SELECT lang AS language, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS size, avg(complexity) AS average_complexity, max(complexity) AS max_complexity FROM ({_DOC}) GROUP BY lang")
def language_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    return d.groupBy(F.col("lang").alias("language")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("size"), F.avg("complexity").alias("average_complexity"), F.max("complexity").alias("max_complexity"))


@_query(f"SELECT count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS total_size, count(DISTINCT lang) AS n_languages, count(*) FILTER (source LIKE '%1%') AS n_tests, coalesce(avg(complexity), 0.0) AS average_complexity FROM ({_DOC})")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    return d.agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_chars").alias("total_size"), F.countDistinct("lang").alias("n_languages"), F.count_if(F.col("source").contains("1")).alias("n_tests"), F.coalesce(F.avg("complexity"), F.lit(0.0)).alias("average_complexity"))


@_query(f"SELECT doc_id, n_lines, complexity FROM ({_DOC})")
def line_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", "n_lines", "complexity")


@_query(f"SELECT coalesce(avg(complexity), 0.0) AS average_complexity, greatest(coalesce(max(complexity), 0), 0) AS max_complexity, count(*) FILTER (complexity > 10) AS n_above FROM ({_DOC})")
def complexity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    return d.agg(F.coalesce(F.avg("complexity"), F.lit(0.0)).alias("average_complexity"), F.greatest(F.coalesce(F.max("complexity"), F.lit(0)), F.lit(0)).alias("max_complexity"), F.count_if(F.col("complexity") > 10).alias("n_above"))


@_query(f"SELECT path, {_LANG_SQL.format('path')} AS language, (lower(path) LIKE '%test%' OR lower(path) LIKE '%spec%') AS is_test, CAST({_COMPLEXITY.format('content')} AS INT) AS complexity, CAST(len(string_split(content, chr(10))) AS INT) AS n_lines, CAST(octet_length(encode(content)) AS BIGINT) AS size FROM {_FILES}")
def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark).files.select("path", "language", "is_test", "complexity", "n_lines", "size")


_TREE = [
    (f"{folder}/{name}", f"// {folder}\nif (x) {{\n  run();\n}}\n" * size)
    for folder in ("src", "src/deep/[id]", "lib", "node_modules/left", "dist", "a b", "vendor/x", ".git")
    for name, size in (("one.ts", 1), ("two.tsx", 3), ("three.test.js", 2), ("four.py", 1), ("five.go", 2), ("six.java", 1), ("seven.md", 1), ("eight.min.js", 1), ("nine.js", 0), ("ten.bundle.js", 1), ("large.ts", 40), ("eleven.go.txt", 1))
]


@_query(f"""WITH t AS (SELECT path AS relative_path, content, {_LANG_SQL.format("path")} AS language FROM {samples.values(_TREE, "path, content")}),
kept AS (SELECT * FROM t WHERE octet_length(encode(content)) <= 1000 AND regexp_matches(relative_path, '[.](ts|tsx|js|jsx|py|go|java|cpp|c|cs|php|rb|rs)$')
  AND NOT regexp_matches(relative_path, '(^|/)(node_modules|dist|build|[.]git|coverage|[.]next|[.]nuxt|vendor|__pycache__)/') AND NOT regexp_matches(relative_path, '[.](min|bundle)[.]js$') ORDER BY relative_path LIMIT 20)
SELECT relative_path, language, CAST(octet_length(encode(content)) AS BIGINT) AS size, CAST(len(string_split(content, chr(10))) AS INT) AS n_lines, CAST({_COMPLEXITY.format("content")} AS INT) AS complexity
FROM kept WHERE language IN ('typescript', 'javascript', 'python', 'go')""")
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated tree through the real reader: folders and endings left out, large files too, the first 20 paths before the language gate.

    What counts as a test depends on whole paths, so on where the tree lies, and is not shown."""
    root = fresh_path(spark, "tree")
    source.write_tree(spark, root, _TREE)
    return source.scan(spark, root, exclude=source.EXCLUDE, max_file_size=1000, max_files=20).select("relative_path", "language", "size", "n_lines", "complexity")


@_query(f"SELECT path, language FROM (SELECT path, {_LANG_SQL.format('path')} AS language FROM {_FILES}) WHERE language IN ('typescript', 'javascript', 'python', 'go')")
def gated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.language_gate(_sample(spark).files).select("path", "language")


# extraction: X2 to X6, X13, X15, M2


@_query(f"SELECT path, unnest(regexp_extract_all(content, 'import\\s+.*?\\s+from\\s+[''\"]([^''\"]+)[''\"]', 1)) AS source FROM {_FILES} WHERE {_LANG_SQL.format('path')} IN ('typescript', 'javascript')")
def js_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _sample(spark)
    return c.imports.join(c.files.filter(fx.is_script(F.col("language"))).select("path"), "path", "left_semi").select("path", "source")


@_query(f"WITH m AS (SELECT path, unnest(regexp_extract_all(content, '(?m)^[ \\t]*(?:from\\s+[^\\s]+\\s+)?import\\s+[^\\s,]+')) AS s FROM {_FILES} WHERE path LIKE '%.py') SELECT path, CASE WHEN s LIKE '%from %' THEN regexp_extract(s, 'from\\s+([^\\s]+)', 1) ELSE regexp_extract(s, 'import\\s+([^\\s,]+)', 1) END AS source FROM m")
def py_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sym.imports(_sample(spark).files.filter("language = 'python'")).select("path", "source")


@_query(f"WITH s AS (SELECT path, unnest(regexp_extract_all(content, 'import\\s*\\([^)]*\\)|import\\s+\"[^\"]+\"')) AS s FROM {_FILES} WHERE path LIKE '%.go') SELECT path, unnest(regexp_extract_all(s, '\"([^\"]+)\"', 1)) AS source FROM s")
def go_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sym.imports(_sample(spark).files.filter("language = 'go'")).select("path", "source")


def _symbol_sql(ending: str, parts: list[tuple[str, str]], exported: str, private: str) -> str:
    numbered = f"(SELECT path, CAST(line AS INT) AS start_line, {_TRIM.format('raw')} AS t FROM (SELECT path, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM {_FILES} WHERE path LIKE '%{ending}'))"
    each = [f"SELECT path, regexp_extract(t, '{p}', 1) AS name, '{k}' AS type, start_line FROM {numbered} WHERE regexp_matches(t, '{p}')" for k, p in parts]
    return f"SELECT *, {exported} AS is_exported, {private} AS is_private FROM (" + " UNION ALL ".join(each) + ")"


@_query(_symbol_sql(".py", [("function", r"^(?:async\s+)?def\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\("), ("class", r"^class\s+([a-zA-Z_][a-zA-Z0-9_]*)")], "true", "starts_with(name, '_')"))
def py_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sym.python_symbols(_sample(spark).files.filter("language = 'python'")).select("path", "name", "type", "start_line", "is_exported", "is_private")


@_query(_symbol_sql(".go", [("function", r"^func\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\("), ("type", r"^type\s+([a-zA-Z_][a-zA-Z0-9_]*)")], "regexp_matches(name, '^[A-Z]')", "regexp_matches(name, '^[a-z]')"))
def go_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sym.go_symbols(_sample(spark).files.filter("language = 'go'")).select("path", "name", "type", "start_line", "is_exported", "is_private")


@_query(f"""WITH {_CODE} SELECT path, name, CASE WHEN word IN ('const', 'let', 'var') THEN 'variable' ELSE word END AS type, line AS start_line, is_exported, starts_with(name, '_') AS is_private FROM declared WHERE name <> ''""")
def ts_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sym.script_symbols(_sample(spark).files, "corrected").select("path", "name", "type", "start_line", "is_exported", "is_private")


_DECISIONS_SQL = " + ".join(f"len(regexp_extract_all(content, '{p}'))" for p in (r"\bif\s*\(", r"\belse\s+if\s*\(", r"\b(?:for|while|do)\s*\(", r"\bcase\s+", r"\bcatch\s*\(", r"\?[^:]*:", r"&&|\|\|"))


@_query(f"SELECT path, CAST(1 + {_DECISIONS_SQL} AS INT) AS complexity FROM {_FILES}")
def function_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark).files.select("path", fx.function_complexity(F.col("content")).alias("complexity"))


@_query(f"SELECT path, array_to_string(list_slice(string_split(content, chr(10)), 2, 3), chr(10)) AS text FROM {_FILES}")
def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark).files.select("path", fx.line_range(F.col("content"), F.lit(2), F.lit(3)).alias("text"))


@_query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("link"))


@_query("SELECT doc_id, CAST(len(r) AS INT) AS n, list_min(r) AS least FROM (SELECT doc_id, list_distinct(regexp_extract_all(text, '\\b([A-Z][A-Za-z0-9_]*)\\b', 1)) AS r FROM documents)")
def type_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = fx.type_references(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", refs.alias("r")).select("doc_id", F.size("r").alias("n"), F.array_min("r").alias("least"))


@_query(f"SELECT path, {_TRIM.format('content')} AS trimmed FROM {_FILES}")
def trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark).files.select("path", fx.trim(F.col("content")).alias("trimmed"))


# rules: F1, O1, A4, J6, W1


@_query("SELECT doc_id, CASE WHEN n_chars > 5000 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN n_chars > 5000 THEN 0 ELSE 1 END AS severity_rank, n_chars AS current FROM documents WHERE n_chars > 3000")
def size_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("n_chars") > 5000, "high").otherwise("medium")
    d = _table(spark, sf_dir, "documents").filter("n_chars > 3000")
    return d.select("doc_id", level.alias("severity"), findings.rank(level).alias("severity_rank"), F.col("n_chars").alias("current"))


@_query("SELECT count(*) AS total, count(*) FILTER (n_chars > 5000) AS high, count(*) FILTER (n_chars <= 5000) AS medium, 0 AS low FROM documents WHERE n_chars > 3000")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.severity_summary(size_rules(spark, sf_dir)).withColumn("low", F.col("low").cast("int"))


_RULES = samples.values([(r, *t, findings._UNITS[r], *findings._WEIGHT[r][0], *findings._WEIGHT[r][1], 0 if r == "file-too-large" else 1) for r, t in findings.THRESHOLDS.items()], "type, medium, high, unit, effort_high, impact_high, effort_low, impact_low, pos")
_OPPORTUNITIES = f"""
WITH files AS (SELECT * FROM {samples.values(samples.LARGE, "path, content")}),
lines AS (SELECT path, unnest(string_split(content, chr(10))) AS t, CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INT) AS line FROM files),
functions AS (SELECT a.path, a.line AS start_line, regexp_extract(a.t, 'function ([a-z0-9]+)', 1) AS symbol, min(z.line) AS end_line FROM lines a JOIN lines z ON z.path = a.path AND z.line > a.line AND z.t = '}}' WHERE regexp_matches(a.t, '^(export )?function ') GROUP BY ALL),
bodies AS (SELECT f.*, (SELECT string_agg(t, chr(10) ORDER BY line) FROM lines l WHERE l.path = f.path AND l.line BETWEEN f.start_line AND f.end_line) AS content FROM functions f),
measured AS (
  SELECT path, NULL AS symbol, CAST(NULL AS INT) AS start_line, CAST(NULL AS INT) AS end_line, 'file-too-large' AS type, CAST(max(line) AS INT) AS current FROM lines GROUP BY path
  UNION ALL SELECT path, symbol, start_line, end_line, 'function-too-long', end_line - start_line + 1 FROM functions
  UNION ALL SELECT path, symbol, start_line, end_line, 'function-too-complex', CAST(1 + {_DECISIONS_SQL} AS INT) FROM bodies
),
judged AS (
  SELECT m.*, unit, CAST(medium AS INT) AS threshold, pos, CASE WHEN current > high THEN 'high' ELSE 'medium' END AS severity,
    CASE WHEN current > high THEN effort_high ELSE effort_low END AS effort, CASE WHEN current > high THEN impact_high ELSE impact_low END AS impact
  FROM measured m JOIN {_RULES} r ON r.type = m.type WHERE current > medium
)
SELECT 'opp-' || row_number() OVER (ORDER BY severity <> 'high', CASE impact WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, path, pos, start_line, type) AS id,
  path, type, severity, symbol, start_line, end_line, current, threshold, unit, effort, impact FROM judged
"""


@_query(_OPPORTUNITIES)
def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(source.from_rows(spark, samples.LARGE, samples.ROOT))
    return findings.opportunities(c.files, c.symbols).select("id", "path", "type", "severity", "symbol", "start_line", "end_line", "current", "threshold", "unit", "effort", "impact")


@_query("SELECT p.event_id, count(e.event_id) AS n_inside FROM events p LEFT JOIN events e ON e.user_id = p.user_id AND e.ts >= p.ts AND e.ts <= p.ts + INTERVAL 1 DAY WHERE p.event_type = 'purchase' GROUP BY p.event_id")
def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the same user within a day of a purchase: equal days meet, then the exact range.

    Each purchase looks in its own day and the next, so a user's whole history is never paired with itself.
    """
    e = _table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01"))
    bought = e.filter("event_type = 'purchase'").select("event_id", F.col("user_id").alias("u"), F.col("ts").alias("a"), F.explode(F.array(day, day + 1)).alias("d"))
    all_ = e.select(F.col("event_id").alias("other"), "user_id", "ts", day.alias("day"))
    inside = (F.col("u") == F.col("user_id")) & (F.col("d") == F.col("day")) & (F.col("ts") >= F.col("a")) & (F.col("ts") <= F.col("a") + F.expr("INTERVAL 1 DAY"))
    return bought.join(all_, inside, "left").groupBy("event_id").agg(F.count("other").alias("n_inside"))


# resolution: J1 to J5


def _resolved(rule: str, mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = _sample(spark, mode)
        listing = resolve.with_folders(c.files) if rule in ("trace", "dead_code") else c.files
        return resolve.resolve(c.imports, listing, rule, mode)

    run.__name__ = f"resolve_{rule}" + ("_corrected" if mode == "corrected" else "")
    return run


for _rule in resolve.RULES:
    _query(_resolve_sql(_rule))(_resolved(_rule, "reference"))
_query(_resolve_sql("graph", True))(_resolved("graph", "corrected"))


@_query(f"""WITH RECURSIVE p AS (SELECT path, list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')) AS parts FROM {samples.values(samples.PATHS, 'path')}),
step(path, k, acc) AS (SELECT path, 0, CAST([] AS VARCHAR[]) FROM p UNION ALL
  SELECT s.path, s.k + 1, CASE WHEN p.parts[s.k + 1] <> '..' THEN list_append(s.acc, p.parts[s.k + 1]) WHEN len(s.acc) > 0 AND s.acc[-1] <> '..' THEN s.acc[:-2] WHEN starts_with(s.path, '/') THEN s.acc ELSE list_append(s.acc, '..') END FROM step s JOIN p ON p.path = s.path WHERE s.k < len(p.parts))
SELECT s.path, CASE WHEN starts_with(s.path, '/') THEN '/' ELSE '' END || array_to_string(acc, '/') AS normal FROM step s JOIN p ON p.path = s.path WHERE k = len(parts)""")
def normal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in samples.PATHS], "path string").select("path", fx.normalize(F.col("path")).alias("normal"))


@_query(f"""WITH d AS (SELECT folder, file, string_split(folder, '/') AS a, string_split(regexp_replace(file, '/[^/]*$', ''), '/') AS b FROM {samples.values(samples.FOLDERS, 'folder, file')}),
c AS (SELECT *, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) AS same FROM d)
SELECT folder, file, CAST(CASE WHEN len(a) > same THEN 100 * (len(a) - same) ELSE len(b) - same END AS INT) AS distance FROM c""")
def proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame(samples.FOLDERS, "folder string, file string")
    return d.select("folder", "file", fx.proximity(F.col("folder"), F.col("file")).alias("distance"))


# graphs: G1 to G9, J14, J7


_EDGES = """
pairs AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem),
ranked AS (
  SELECT a.s AS src, b.s AS dst, row_number() OVER (PARTITION BY a.s ORDER BY count(*) DESC, b.s) AS r
  FROM pairs a JOIN pairs b ON a.o = b.o AND a.s <> b.s GROUP BY a.s, b.s
),
edges AS (SELECT src, dst FROM ranked WHERE r <= 2)
"""
_REACH = "reach(node) AS (SELECT CAST(0 AS BIGINT) UNION SELECT e.dst FROM reach JOIN edges e ON e.src = reach.node)"
_CLOSURE = "closure(a, b) AS (SELECT src, dst FROM edges UNION SELECT c.a, e.dst FROM closure c JOIN edges e ON c.b = e.src)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier the two that share most orders with it.  An order has few lines, so its pairs are few."""
    pairs = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s")).distinct()
    other = pairs.select(F.col("o").alias("p"), F.col("s").alias("dst"))
    counts = pairs.join(other, (F.col("o") == F.col("p")) & (F.col("s") != F.col("dst"))).groupBy(F.col("s").alias("src"), "dst").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst")))
    return ranked.filter("r <= 2").select("src", "dst")


def _nodes(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "node bigint")


@_query(f"WITH {_EDGES} SELECT src, dst FROM edges")
def edges_cosupply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@_query(f"WITH {_EDGES} SELECT DISTINCT src AS node FROM edges WHERE dst = 0 AND src <> 0")
def direct_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dependents(_edges(spark, sf_dir), 0, own=False)


@_query(f"WITH {_EDGES} SELECT DISTINCT dst AS node FROM edges WHERE src = 0")
def direct_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dependencies(_edges(spark, sf_dir), 0)


@_query(f"WITH RECURSIVE {_EDGES}, back(node) AS (SELECT src FROM edges WHERE dst = 1 UNION SELECT e.src FROM back JOIN edges e ON e.dst = back.node) SELECT node FROM back WHERE node <> 1 AND node NOT IN (SELECT src FROM edges WHERE dst = 1)")
def transitive_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.transitive_dependents(_edges(spark, sf_dir), 1).select("node")


@_query(f"WITH RECURSIVE {_EDGES}, {_REACH} SELECT node FROM reach")
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(_edges(spark, sf_dir), _nodes(spark, 0)).select("node")


@_query(f"WITH RECURSIVE {_EDGES}, {_REACH} SELECT DISTINCT src AS node FROM edges WHERE src NOT IN (SELECT node FROM reach)")
def unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = durable(_edges(spark, sf_dir), "edges")
    return e.select(F.col("src").alias("node")).distinct().join(graph.reachable(e, _nodes(spark, 0)), "node", "left_anti")


@_query(f"WITH RECURSIVE {_EDGES}, depths(node, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT e.dst, d.depth + 1 FROM depths d JOIN edges e ON e.src = d.node WHERE d.depth < 4) SELECT node, min(depth) AS depth FROM depths GROUP BY node")
def trace_depth3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(_edges(spark, sf_dir), _nodes(spark, 0), 4)


@_query(f"""WITH RECURSIVE {_EDGES}, walks(node, path, depth) AS (
  SELECT CAST(0 AS BIGINT), [CAST(0 AS BIGINT)], 0 UNION ALL SELECT e.dst, list_append(w.path, e.dst), w.depth + 1 FROM walks w JOIN edges e ON e.src = w.node WHERE w.depth < 3
), least AS (SELECT node, arg_min(path, {{'d': depth, 'p': path}}) AS path, min(depth) AS depth FROM walks GROUP BY node)
SELECT DISTINCT array_to_string(list_append(l.path, e.dst), '>') AS path, CAST(l.depth + 1 AS INT) AS depth FROM least l JOIN edges e ON e.src = l.node""")
def trace_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.chains(durable(_edges(spark, sf_dir), "edges"), 0, 3).select(F.array_join("path", ">").alias("path"), "depth")


@_query(f"WITH RECURSIVE {_EDGES}, {_CLOSURE} SELECT a, b FROM closure")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(_edges(spark, sf_dir))


@_query(f"WITH RECURSIVE {_EDGES}, {_CLOSURE} SELECT a AS node FROM closure WHERE a = b")
def cycle_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycle_members(_edges(spark, sf_dir))


@_query(f"WITH {_EDGES} SELECT src, dst FROM edges WHERE src % 10 <> 3 AND dst % 10 <> 3")
def partial_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _table(spark, sf_dir, "supplier").filter("s_suppkey % 10 = 3").select(F.col("s_suppkey").alias("node"))
    return graph.without(_edges(spark, sf_dir), gone)


@_query(f"""WITH RECURSIVE {_CODE}, {_graph_sql("trace", True)}, near(node) AS (SELECT '/app/src/main.ts' UNION SELECT dst FROM near JOIN links ON src = node),
walks(path, last) AS (
  SELECT [src, dst], dst FROM links WHERE src IN (SELECT node FROM near) AND dst >= src
  UNION ALL SELECT list_append(path, dst), dst FROM walks JOIN links ON src = last WHERE last <> path[1] AND (dst = path[1] OR (dst > path[1] AND NOT list_contains(path, dst)))
)
SELECT array_to_string(path, '>') AS files, CASE WHEN len(path) - 1 > 3 THEN 'high' ELSE 'medium' END AS severity FROM walks WHERE last = path[1]""")
def corpus_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(_sample(spark, "corrected").edges("trace"), "/app/src/main.ts").select(F.array_join("files", ">").alias("files"), "severity")


_RINGS = [(f"{n}-{k}", f"{n}-{(k + 1) % n}") for n in (1, 2, 3, 4, 12) for k in range(n)] + [("hub", f"{n}-0") for n in (1, 2, 3, 4, 12)]


@_query(f"""WITH RECURSIVE links AS (SELECT * FROM {samples.values(_RINGS, "src, dst")}), walks(first, last, n) AS (SELECT src, dst, 1 FROM links WHERE src <> 'hub' UNION SELECT w.first, l.dst, w.n + 1 FROM walks w JOIN links l ON l.src = w.last WHERE w.first <> w.last)
SELECT min(first) AS least, CAST(n AS INT) AS n, CASE WHEN n > 3 THEN 'high' ELSE 'medium' END AS severity FROM walks WHERE first = last GROUP BY n""")
def ring_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of one to twelve nodes: each is a cycle, severe from four nodes on."""
    found = graph.cycles(spark.createDataFrame(_RINGS, "src string, dst string"), "hub")
    return found.select(F.col("files")[0].alias("least"), (F.size("files") - 1).alias("n"), "severity")


# scores: M5 to M7, P18


@_query(f"""WITH RECURSIVE {_EDGES}, {_CLOSURE},
d AS (SELECT dst AS node, count(*) AS direct FROM edges WHERE src <> dst GROUP BY dst),
t AS (SELECT b AS node, count(*) AS total FROM closure WHERE a <> b GROUP BY b)
SELECT s_suppkey AS node, coalesce(direct, 0) AS direct, coalesce(total, 0) - coalesce(direct, 0) AS transitive,
  least(100.0, round(coalesce(direct, 0) * 5.0 + (coalesce(total, 0) - coalesce(direct, 0)) * 2.0 + s_nationkey * 2.0 + (100.0 - 80.0) * 0.3))::DOUBLE AS risk
FROM supplier LEFT JOIN d ON d.node = s_suppkey LEFT JOIN t ON t.node = s_suppkey""")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = durable(_edges(spark, sf_dir), "edges")
    direct = e.filter("src != dst").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("d"))
    total = reach.sizes(e).withColumnRenamed("n", "t")
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), "s_nationkey")
    one = s.join(direct, "node", "left").join(total, "node", "left").withColumns({"direct": F.coalesce("d", F.lit(0)), "transitive": F.coalesce("t", F.lit(0)) - F.coalesce("d", F.lit(0))})
    return one.select("node", "direct", "transitive", scores.risk(F.col("direct"), F.col("transitive"), F.col("s_nationkey"), F.lit(80.0)).alias("risk"))


@_query(f"SELECT lang, greatest(0.0, least(100.0, 100.0 - 100.0 * 0.3 - greatest(avg(complexity) - 10.0, 0.0) * 2 - count(*) FILTER (complexity > 1000) * 2))::DOUBLE AS safety FROM ({_DOC}) GROUP BY lang")
def safety_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    return d.groupBy("lang").agg(scores.safety(F.avg("complexity"), F.count_if(F.col("complexity") > 1000)).alias("safety"))


@_query(f"""SELECT source, greatest(0.0, least(100.0, round(100.0 - CASE WHEN a > 10 THEN least(30.0, (a - 10) * 3.0) ELSE 0.0 END - (100.0 - c) * 0.4 - least(30.0, o * 0.5))))::DOUBLE AS health
FROM (SELECT source, avg(complexity) AS a, 100.0 * count(*) FILTER (n_lines > 5) / count(*) AS c, count(*) FILTER (n_chars > 5000) AS o FROM ({_DOC}) GROUP BY source)""")
def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).groupBy("source").agg(F.avg("complexity").alias("a"), scores.percentage(F.count_if(F.col("n_lines") > 5), F.count(F.lit(1))).alias("c"), F.count_if(F.col("n_chars") > 5000).alias("o"))
    return d.select("source", scores.health(F.col("a"), F.col("c"), F.col("o")).alias("health"))


@_query("SELECT doc_id, CASE WHEN p > 70 THEN 'high' WHEN p > 40 THEN 'medium' ELSE 'low' END AS risk, CASE WHEN p >= 80 THEN 'high' WHEN p >= 60 THEN 'medium' ELSE 'low' END AS safety, CASE WHEN p >= 80 THEN 'good' WHEN p >= 50 THEN 'fair' ELSE 'poor' END AS coverage, CASE WHEN p < 20 THEN 'low' WHEN p < 50 THEN 'medium' WHEN p < 80 THEN 'high' ELSE 'critical' END AS impact FROM (SELECT doc_id, n_chars % 101 AS p FROM documents)")
def labels_of_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("n_chars") % 101
    return _table(spark, sf_dir, "documents").select("doc_id", scores.risk_label(p).alias("risk"), scores.safety_label(p).alias("safety"), scores.coverage_label(p).alias("coverage"), scores.impact_label(p).alias("impact"))


# joins and sets: J7, J8, J11, J12, 2.10


@_query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return _table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@_query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return _table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@_query(f"SELECT id, array_to_string(list_sort(list_filter(list_distinct(used), lambda x: NOT list_contains(declared, x) AND x NOT IN ({', '.join(map(samples.quoted, BUILT_IN))}))), ',') AS parameters FROM {samples.values(samples.NAMES, 'id, used, declared')}")
def free_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame(samples.NAMES, "id int, used array<string>, declared array<string>")
    return d.select("id", F.array_join(fx.free_names(F.col("used"), F.col("declared"), F.array(*map(F.lit, BUILT_IN))), ",").alias("parameters"))


@_query("SELECT 'union' AS op, k FROM (SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer) UNION ALL SELECT 'intersect', k FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT 'except', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    name = lambda df, op: df.select(F.lit(op).alias("op"), "k")
    return name(a.union(b).distinct(), "union").unionByName(name(a.intersect(b), "intersect")).unionByName(name(b.subtract(a), "except"))


# coverage and reports: S5 to S7, S11, S12, A7, A8, A11, M9, P11 to P13, O3


_COVER = "(SELECT source AS path, CAST(sum(quality) AS INT) AS covered, CAST(count(*) AS INT) AS total, 100.0 * sum(quality) / count(*) AS pct FROM documents JOIN labels USING (doc_id) GROUP BY source)"


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = _table(spark, sf_dir, "documents").select("doc_id", "source"), _table(spark, sf_dir, "labels").select("doc_id", "quality")
    g = d.join(lab, "doc_id").groupBy(F.col("source").alias("path")).agg(F.sum("quality").cast("int").alias("covered"), F.count(F.lit(1)).cast("int").alias("total"))
    return g.withColumn("pct", scores.percentage(F.col("covered"), F.col("total")))


@_query(f"SELECT round(avg(pct), 9) AS overall, round(100.0 * sum(covered) / sum(total), 9) AS lines, avg(pct) >= 80 AS meets, count(*) AS n_files FROM {_COVER}")
def coverage_mean_vs_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = cov.overall(_covered(spark, sf_dir), 80)
    return one.select(F.round("overall", 9).alias("overall"), F.round("lines", 9).alias("lines"), "meets", "n_files")


@_query(f"SELECT path, covered, total, pct FROM {_COVER} ORDER BY pct, path LIMIT 15")
def coverage_lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.lowest(_covered(spark, sf_dir)).select("path", "covered", "total", "pct")


@_query(f"SELECT path, pct FROM {_COVER} WHERE starts_with(path, 'src1') AND pct < 90")
def coverage_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.below(_covered(spark, sf_dir), "src1").filter("pct < 90").select("path", "pct")


@_query("SELECT n_tests, n_sources, CASE WHEN n_sources > 0 THEN CAST(n_tests AS DOUBLE) / n_sources ELSE 0.0 END AS ratio FROM (SELECT count(*) FILTER (contains(lower(url), 'test') OR contains(lower(url), '1')) AS n_tests, count(*) FILTER (NOT (contains(lower(url), 'test') OR contains(lower(url), '1'))) AS n_sources FROM pages)")
def test_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower("url").contains("test") | F.lower("url").contains("1")
    one = _table(spark, sf_dir, "pages").agg(F.count_if(t).alias("n_tests"), F.count_if(~t).alias("n_sources"))
    return one.withColumn("ratio", scores.ratio(F.col("n_tests"), F.col("n_sources")))


@_query(f"SELECT count(*) FILTER (t) AS n_tests, count(*) FILTER (NOT t) AS n_sources FROM (SELECT regexp_matches(path, '\\.(test|spec)\\.') AS t FROM {_FILES} WHERE regexp_matches(path, '\\.(ts|tsx|js|jsx)$'))")
def test_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.test_counts(_sample(spark).files)


_LOG = samples.values(samples.LOGS, "kind, n, value")


@_query(f"""SELECT kind AS type, regexp_extract(value, '(.+):(\\d+):(\\d+)\\s+(error|warning)\\s+(.+)', 5) AS message, regexp_extract(value, '(.+):(\\d+):(\\d+)', 1) AS file, CAST(regexp_extract(value, '(.+):(\\d+):(\\d+)', 2) AS INT) AS line FROM {_LOG} WHERE kind = 'lint' AND regexp_matches(value, '(.+):(\\d+):(\\d+)\\s+(error|warning)\\s+(.+)')
UNION ALL SELECT kind, regexp_extract(value, 'TS\\d+:\\s+(.+)', 1), regexp_extract(value, '(.+)\\((\\d+),', 1), CAST(regexp_extract(value, '\\((\\d+),', 1) AS INT) FROM {_LOG} WHERE kind = 'typescript' AND regexp_matches(value, 'error\\s+TS')
UNION ALL SELECT kind, {_TRIM.format('value')}, NULL, NULL FROM {_LOG} WHERE kind = 'test' AND (contains(value, 'FAIL') OR contains(value, 'Error:'))""")
def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.validation(_logs(spark))["errors"].select("type", "message", "file", "line")


def _logs(spark: SparkSession) -> dict[str, DataFrame]:
    d = spark.createDataFrame(samples.LOGS, "kind string, n int, value string")
    return {k: d.filter(F.col("kind") == k) for k in ("lint", "typescript", "test")}


@_query(f"SELECT kind AS type, count(*) AS n FROM {_LOG} WHERE (kind = 'lint' AND regexp_matches(value, '(.+):(\\d+):(\\d+)\\s+(error|warning)\\s+(.+)')) OR (kind = 'typescript' AND contains(value, 'error TS')) OR (kind = 'test' AND (contains(value, 'FAIL') OR contains(value, 'Error:'))) GROUP BY kind")
def log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.validation(_logs(spark))["counts"]


@_query(f"""WITH doc AS (SELECT {samples.quoted(samples.COVERAGE)}::JSON AS j), f AS (SELECT path, json_extract(j, '$."' || path || '"') AS b FROM (SELECT j, unnest(json_keys(j)) AS path FROM doc) WHERE path <> 'total'),
s AS (SELECT path, b, unnest(json_keys(b, '$.s')) AS k FROM f), c AS (SELECT path, CAST(json_extract(b, '$.s."' || k || '"') AS INT) AS n, CAST(json_extract(b, '$.statementMap."' || k || '".start.line') AS INT) AS line FROM s)
SELECT f.path, CAST(count(n) FILTER (n > 0) AS INT) AS covered, CAST(count(n) AS INT) AS total, CASE WHEN count(n) > 0 THEN 100.0 * count(n) FILTER (n > 0) / count(n) ELSE 0.0 END::DOUBLE AS pct, CAST(count(n) FILTER (n = 0 AND line > 0) AS INT) AS n_regions, count(n) FILTER (n = 0 AND line > 0) > 0 AS missing
FROM f LEFT JOIN c ON c.path = f.path GROUP BY f.path""")
def json_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reports.coverage_json(spark.createDataFrame([(samples.COVERAGE,)], "value string"))
    return d.select("path", "covered", "total", "pct", F.size("regions").alias("n_regions"), "missing")


@_query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("total"))


# top rows: W2, O2, L1, A13


@_query("SELECT l_suppkey, l_orderkey, l_linenumber, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 10")
def findings_topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return reports.top_rows(rows, "l_suppkey", [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 10).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@_query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 20")
def top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(20)


@_query("SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) AS roles, count(*) AS n FROM conversations GROUP BY conv_id")
def grouped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"), F.count(F.lit(1)).alias("n"))
    return rows.select("conv_id", F.array_join(F.transform("r", lambda x: x["role"]), ",").alias("roles"), "n")


# text transforms and tools: T1 to T9, X1, X7 to X14, A3, A9, A10


@_query("""WITH RECURSIVE c AS (SELECT conv_id, text, lag(text) OVER w AS old, row_number() OVER w AS k FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)),
p AS (SELECT 'c/' || conv_id || '/' || k AS file_path, CASE WHEN old IS NULL THEN 'create' ELSE 'update' END AS operation, string_split(coalesce(old, ''), chr(10)) AS a, string_split(text, chr(10)) AS b FROM c),
steps(file_path, i, j, plus, minus) AS (
  SELECT file_path, 1, 1, 0, 0 FROM p WHERE operation = 'update'
  UNION ALL
  SELECT file_path, CASE WHEN same OR NOT adds THEN i + 1 ELSE i END, CASE WHEN same OR adds THEN j + 1 ELSE j END, CASE WHEN NOT same AND adds THEN plus + 1 ELSE plus END, CASE WHEN NOT same AND NOT adds THEN minus + 1 ELSE minus END
  FROM (SELECT s.*, i <= len(a) AND j <= len(b) AND a[i] = b[j] AS same,
          j <= len(b) AND (i > len(a) OR coalesce(j + nullif(list_position(b[j:], a[i]), 0), 1000000000) < coalesce(i + nullif(list_position(a[i:], b[j]), 0), 1000000000)) AS adds
        FROM steps s JOIN p USING (file_path) WHERE i <= len(a) OR j <= len(b))
)
SELECT file_path, operation, CAST(plus AS INT) AS additions, CAST(minus AS INT) AS deletions FROM steps JOIN p USING (file_path) WHERE i > len(a) AND j > len(b)
UNION ALL SELECT file_path, operation, CAST(len(b) AS INT), CAST(0 AS INT) FROM p WHERE operation = 'create'""")
def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines added and deleted from turn to turn, by the greedy rule."""
    return diff_preview(spark, sf_dir).select("file_path", "operation", "additions", "deletions")


@_query()
def diff_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation against the one before, as diffs of one text."""
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    both = c.withColumns({"old": F.lag("text").over(w), "k": F.row_number().over(w)})
    name = F.concat_ws("/", F.lit("c"), "conv_id", "k")
    changes = both.select(name.alias("file_path"), F.when(F.col("old").isNull(), "create").otherwise("update").alias("operation"), F.col("text").alias("new_content"))
    return diffs.diffs(changes, both.filter("old is not null").select(name.alias("path"), F.col("old").alias("content")))


def _dead_sql(corrected: bool) -> str:
    """Files that nothing reaches, exports without a use, imports that are not used, numbered."""
    uses = "SELECT name FROM named WHERE path IN (SELECT node FROM reached)" + ("" if corrected else " UNION SELECT name FROM words WHERE path IN (SELECT node FROM reached)")
    return f"""WITH RECURSIVE {_CODE}, {_graph_sql("dead_code", corrected)}, reached(node) AS (SELECT '/app/src/main.ts' UNION SELECT dst FROM reached JOIN links ON src = node),
apart AS (SELECT * FROM exported WHERE path <> '/app/src/main.ts'), counted AS (SELECT path, name, count(*) AS n FROM words GROUP BY path, name),
found AS (
  SELECT DISTINCT path, CAST(1 AS INT) AS line, CAST(NULL AS VARCHAR) AS symbol, 'unused-export' AS type, 'high' AS severity FROM apart WHERE path NOT IN (SELECT node FROM reached)
  UNION ALL SELECT path, line, name, 'unused-export', 'medium' FROM apart WHERE path IN (SELECT node FROM reached) AND name NOT IN ({uses})
  UNION ALL SELECT i.path, min(i.line), i.name, 'unused-import', 'low' FROM named i LEFT JOIN counted c ON c.path = i.path AND c.name = i.name WHERE i.kind = 'named' AND i.path IN (SELECT node FROM reached) GROUP BY i.path, i.name HAVING coalesce(max(c.n), 0) <= count(*)
)
SELECT path, line, symbol, type, severity, 'high' AS confidence, 'finding-' || row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, path, line, symbol NULLS FIRST) AS id FROM found"""


@_query(_dead_sql(False))
def dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.find_dead_code(_sample(spark), ["/app/src/main.ts"])["findings"].drop("description", "suggestion")


@_query(_dead_sql(True))
def dead_code_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.find_dead_code(_sample(spark, "corrected"), ["/app/src/main.ts"])["findings"].drop("description", "suggestion")


def _types_sql(files: list, last: str) -> str:
    """Definitions of types that begin a line and end with a brace alone in one, or with the line."""
    code = _CODE.replace(_FILES, samples.values(files, "path, content"))
    return f"""WITH {code},
spans AS (SELECT d.path, d.name, d.is_exported, d.line AS a, CASE WHEN word = 'type' THEN d.line ELSE (SELECT min(z.line) FROM clean z WHERE z.path = d.path AND z.line > d.line AND z.raw = '}}') END AS z
  FROM declared d JOIN files f ON f.path = d.path WHERE word IN ('interface', 'type') AND name <> '' AND len(string_split(content, chr(10))) >= 3 AND NOT regexp_matches(d.path, '[.]types[.]tsx?$|[.]d[.]ts$|(^|/)types[.]tsx?$')),
bodies AS (SELECT s.path, s.name, s.is_exported, s.a, s.z, string_agg(c.raw, chr(10) ORDER BY c.line) AS body FROM spans s JOIN clean c ON c.path = s.path AND c.line BETWEEN s.a AND s.z GROUP BY s.path, s.name, s.is_exported, s.a, s.z),
found AS (SELECT *, regexp_replace(path, '[^/]*$', '') || name || '.types.ts' AS target, CASE WHEN is_exported THEN '' ELSE 'export ' END || body AS content FROM bodies)
{last}"""


@_query(_types_sql(samples.FILES, """SELECT name AS type_name, path AS source_file, target AS target_file, content AS type_content, false AS is_centralized, 'import { ' || name || ' } from ''./' || name || '.types'';' AS import_statement, CAST(a - 1 AS INT) AS start_line, CAST(z - 1 AS INT) AS end_line FROM found"""))
def type_abstractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return types.abstractions(_sample(spark).files, large=3)


_CHANGES_SQL = """, heads AS (SELECT f.target, string_agg('import { ' || o.name || ' } from ''./' || o.name || '.types'';', chr(10) ORDER BY o.name) AS head FROM found f JOIN found o ON o.name <> f.name AND regexp_matches(f.content, '\\b' || o.name || '\\b') GROUP BY f.target),
last AS (SELECT path, coalesce(max(line) FILTER (regexp_matches(t, '^import[ {]')), 0) AS line FROM clean GROUP BY path),
pieces AS (
  SELECT c.path, CASE WHEN c.line <= l.line THEN 0 ELSE 3 END AS part, c.line AS k, c.raw AS text FROM clean c JOIN last l ON l.path = c.path WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.path = c.path AND c.line BETWEEN f.a AND f.z)
  UNION ALL SELECT path, 1, -a, 'import type { ' || name || ' } from ''./' || name || '.types'';' FROM found
  UNION ALL SELECT path, 2, -a, 'export type { ' || name || ' } from ''./' || name || '.types'';' FROM found WHERE is_exported
)
SELECT path AS file_path, 'update' AS operation, string_agg(text, chr(10) ORDER BY part, k) AS new_content FROM pieces WHERE path IN (SELECT path FROM found) GROUP BY path
UNION ALL SELECT f.target, 'create', coalesce(head || chr(10) || chr(10), '') || content FROM found f LEFT JOIN heads h ON h.target = f.target"""


@_query(_types_sql(samples.TYPED, _CHANGES_SQL))
def type_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources without the definitions that are taken out, and the files that hold them, with imports across."""
    files = source.from_rows(spark, samples.TYPED, samples.ROOT)
    found = types.abstractions(files, large=3)
    return types.source_changes(files, found).unionByName(types.type_files(found))


@_query(f"""WITH {_CODE} SELECT w.path, w.line, regexp_replace(c.raw, '\\bfmt\\b', 'format', 'g') AS text FROM words w JOIN clean c ON c.path = w.path AND c.line = w.line WHERE w.name = 'fmt'""")
def rename_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.rename(_sample(spark), "/app/src/util/format.ts", "fmt", "format")["references"]


_EXTRACT_SQL = f"""WITH {_CODE}, part AS (SELECT * FROM clean WHERE path = '/app/src/main.ts' AND line BETWEEN 9 AND 11),
used AS (SELECT DISTINCT name FROM words WHERE path = '/app/src/main.ts' AND line BETWEEN 9 AND 11 AND name NOT IN ({', '.join(map(samples.quoted, BUILT_IN))}) AND name NOT IN (SELECT regexp_extract(t, '(?:const|let|var)\\s+([a-z]+)', 1) FROM part)),
one AS (SELECT (SELECT string_agg(raw, chr(10) ORDER BY line) FROM part) AS code, string_agg(name, ',' ORDER BY name) AS parameters, string_agg(name || ': any', ', ' ORDER BY name) AS typed, string_agg(name, ', ' ORDER BY name) AS listed FROM used)
SELECT code, parameters, CASE WHEN regexp_matches(code, 'return|[^=<>!]=[^>=]') THEN 'any' ELSE 'void' END AS return_type, CAST(NULL AS VARCHAR) AS return_variable, 'function each(' || typed || ') {{' || chr(10) || code || chr(10) || '}}' AS signature, 'each(' || listed || ');' AS call FROM one"""


@_query(_EXTRACT_SQL)
def extract_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tools.extract(_sample(spark), "/app/src/main.ts", 9, 11, "each")
    return rows.withColumn("parameters", F.array_join("parameters", ","))


@_query(f"""WITH RECURSIVE {_CODE}, {_graph_sql("impact")}, above(node) AS (SELECT src FROM links WHERE dst = '/app/src/util/format.ts' UNION SELECT src FROM above JOIN links ON dst = node),
near AS (SELECT DISTINCT src AS node FROM links WHERE dst = '/app/src/util/format.ts' AND src <> dst),
one AS (SELECT (SELECT count(*) FROM near) AS direct, (SELECT count(*) FROM above WHERE node NOT IN (SELECT node FROM near) AND node <> '/app/src/util/format.ts') AS transitive,
  CASE WHEN EXISTS (SELECT 1 FROM files WHERE path IN ('/app/src/util/format.test.ts', '/app/src/util/format.spec.ts', '/app/src/util/__tests__/format.test.ts')) THEN 80.0 ELSE 0.0 END::DOUBLE AS coverage,
  (SELECT {_COMPLEXITY.format('content')} FROM files WHERE path = '/app/src/util/format.ts') AS complexity)
SELECT CAST(direct AS BIGINT) AS direct, CAST(transitive AS BIGINT) AS transitive, coverage, CAST(complexity AS BIGINT) AS complexity, CAST(direct + transitive AS BIGINT) AS total, least(100.0, round(direct * 5.0 + transitive * 2.0 + complexity * 2.0 + (100.0 - coverage) * 0.3))::DOUBLE AS risk,
  CASE WHEN least(100.0, round(direct * 5.0 + transitive * 2.0 + complexity * 2.0 + (100.0 - coverage) * 0.3)) > 70 THEN 'high' WHEN least(100.0, round(direct * 5.0 + transitive * 2.0 + complexity * 2.0 + (100.0 - coverage) * 0.3)) > 40 THEN 'medium' ELSE 'low' END AS risk_label FROM one""")
def impact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.impact(_sample(spark), "/app/src/util/format.ts")["summary"].drop("recommendations")


@_query(f"""WITH {_CODE}, {_OTHERS}, kinds AS (
  SELECT path, bool_or(word IN ('function', 'func', 'class')) AS code, bool_or(word IN ('interface', 'type')) AS types FROM (SELECT path, word FROM declared WHERE name <> '' UNION ALL SELECT path, unnest(regexp_extract_all(content, '(?m)^(func|type)\\s+[a-zA-Z_]', 1)) FROM files WHERE path LIKE '%.go') GROUP BY path),
one AS (SELECT count(*) AS n_files, CAST(sum(octet_length(encode(content))) AS BIGINT) AS total_lines, avg({_COMPLEXITY.format('content')}) AS average_complexity,
  100.0 * count(*) FILTER (lower(f.path) LIKE '%test%' OR lower(f.path) LIKE '%spec%') / count(*) FILTER (NOT (lower(f.path) LIKE '%test%' OR lower(f.path) LIKE '%spec%')) AS test_coverage, count(*) FILTER (code AND types) AS type_abstractions FROM files f LEFT JOIN kinds k ON k.path = f.path)
SELECT *, CAST(0 AS INT) AS complex_functions, CAST(0 AS INT) AS duplicate_code,
  greatest(0.0, least(100.0, round(100.0 - CASE WHEN average_complexity > 10 THEN least(30.0, (average_complexity - 10) * 3.0) ELSE 0.0 END - (100.0 - test_coverage) * 0.4 - least(30.0, type_abstractions * 0.5))))::DOUBLE AS score FROM one""")
def project_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.project_health(_sample(spark)).drop("recommendations")


@_query(f"""SELECT average_complexity, max_complexity, safety, CASE WHEN safety >= 80 THEN 'high' WHEN safety >= 60 THEN 'medium' ELSE 'low' END AS safety_label FROM (
  SELECT avg(c) AS average_complexity, CAST(max(c) AS INT) AS max_complexity, greatest(0.0, least(100.0, 100.0 - 30.0 - greatest(avg(c) - 10.0, 0.0) * 2 - count(*) FILTER (c > 10) * 2))::DOUBLE AS safety FROM (SELECT {_COMPLEXITY.format('content')} AS c FROM {_FILES}))""")
def context_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.context(_sample(spark))["summary"].select("average_complexity", "max_complexity", "safety", "safety_label")


# the rest of the inventory, over the sample: P3, P6, P9, P14, P15, M8, M13, S7, S12, A1, A3, A9, A10, A12, J10, N1


@_query(f"SELECT path, substr(path, {len(samples.ROOT) + 2}) AS relative_path FROM {_FILES}")
def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark).files.select("path", "relative_path")


@_query(f"""SELECT path, CAST(regexp_matches(path, '[.]types[.]tsx?$') OR regexp_matches(path, '[.]d[.]ts$') OR regexp_matches(path, '(^|/)types[.]tsx?$') AS INT) AS type_only FROM {samples.values([p for p, _ in samples.TYPE_PATHS], 'path')}""")
def type_only_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([(p,) for p, _ in samples.TYPE_PATHS], "path string")
    return d.select("path", fx.is_type_only(F.col("path")).cast("int").alias("type_only"))


@_query(f"SELECT count(*) AS n_files, CAST(sum(octet_length(encode(content))) AS BIGINT) AS total_size, avg({_COMPLEXITY.format('content')}) AS average_complexity, count(*) FILTER (lower(path) LIKE '%test%' OR lower(path) LIKE '%spec%') AS n_tests FROM {_FILES}")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark).stats().select("n_files", "total_size", "average_complexity", "n_tests")


@_query(f"SELECT {_LANG_SQL.format('path')} AS language, count(*) AS n FROM {_FILES} GROUP BY 1")
def files_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark).stats().select(F.explode("by_language").alias("language", "n"))


@_query(f"""WITH {_CODE}, {_OTHERS}, every AS (SELECT path, line, name FROM declared WHERE is_exported AND name <> '' UNION ALL SELECT path, line, name FROM others WHERE is_exported)
SELECT path, string_agg(name, ',' ORDER BY line, name) AS names FROM every GROUP BY path""")
def exported_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.exported_names(_sample(spark)).select("path", F.array_join("names", ",").alias("names"))


@_query(f"""WITH {_CODE}, {_OTHERS} SELECT name FROM declared WHERE starts_with(name, '_') UNION ALL SELECT name FROM others WHERE is_private""")
def private_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark).symbols.filter("is_private").select("name")


@_query("""SELECT doc_id, CAST(n // 10 AS VARCHAR) || '.' || CAST(n % 10 AS VARCHAR) AS eighths, printf('%.2f', n_chars / 7.0) AS sevenths, CASE WHEN n_chars % 125 = 0 THEN CAST(m // 100 AS VARCHAR) || '.' || lpad(CAST(m % 100 AS VARCHAR), 2, '0') ELSE printf('%.2f', n_chars / 1000.0) END AS thousandths
FROM (SELECT doc_id, n_chars, (n_chars * 5 + 2) // 4 AS n, (n_chars + 5) // 10 AS m FROM documents)""")
def shown_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighths have exact halves, thousandths halves in decimals that are none in binary, sevenths none."""
    n = F.col("n_chars")
    return _table(spark, sf_dir, "documents").select("doc_id", scores.shown(n / 8.0, 1).alias("eighths"), scores.shown(n / 7.0, 2).alias("sevenths"), scores.shown(n / 1000.0, 2).alias("thousandths"))


@_query(f"""SELECT trim(cells[1]) AS path, CAST(trim(cells[2]) AS DOUBLE) AS pct, CAST(trim(cells[2]) AS DOUBLE) < 100 AS missing FROM (SELECT string_split(value, '|') AS cells FROM {samples.values(samples.TABLE, 'value')}) WHERE len(cells) >= 5 AND TRY_CAST(trim(cells[2]) AS DOUBLE) IS NOT NULL AND TRY_CAST(trim(cells[5]) AS DOUBLE) IS NOT NULL""")
def coverage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.coverage_text(spark.createDataFrame([(x,) for x in samples.TABLE], "value string")).select("path", "pct", "missing")


_REPLY_SQL = rf"""
WITH r AS (SELECT n, trim(CASE WHEN regexp_matches(value, '```json') THEN regexp_extract(value, '```json\s*([\s\S]*?)\s*```', 1) ELSE value END) AS body FROM {samples.values(samples.REPLIES, 'n, value')}),
j AS (SELECT n, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM r),
a AS (SELECT n, CASE WHEN json_type(j) = 'OBJECT' AND json_type(j, '$.suggestions') = 'ARRAY' THEN json_extract(j, '$.suggestions[*]') END AS items FROM j),
g AS (SELECT n, items, items IS NOT NULL AND len(list_filter(items, lambda x: json_type(x) = 'NULL')) = 0 AS good FROM a),
i AS (SELECT n, unnest(items[:4]) AS s, generate_subscripts(items[:4], 1) AS pos FROM g WHERE good),
f AS (SELECT *, coalesce(nullif(CAST(json_extract(s, '$.riskScore') AS DOUBLE), 0), 50.0) AS risk FROM i)
SELECT n, 'suggestion-' || pos AS id, coalesce(nullif(json_extract_string(s, '$.type'), ''), 'unknown') AS type, coalesce(nullif(json_extract_string(s, '$.title'), ''), 'Untitled suggestion') AS title,
  coalesce(CAST(json_extract(s, '$.startLine') AS INT), 0) AS start_line, coalesce(CAST(json_extract(s, '$.endLine') AS INT), 0) AS end_line,
  CASE {' '.join(f"WHEN risk < {b} THEN '{t}'" for b, t in reports.IMPACTS[:-1])} ELSE '{reports.IMPACTS[-1][1]}' END AS estimated_impact, risk AS risk_score,
  coalesce(CAST(json_extract(s, '$.autoApplicable') AS BOOLEAN), false) AS auto_applicable, left(coalesce(json_extract_string(s, '$.reasoning'), ''), 6) AS reasoning, coalesce(json_extract_string(s, '$.priority'), 'medium') AS priority FROM f
UNION ALL SELECT n, 'error-1', 'analysis-error', 'Unable to parse suggestions', 0, 0, 'Unknown', 0.0, false, 'Error:', 'low' FROM g WHERE NOT good
"""


@_query(_REPLY_SQL)
def reply_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.suggestions(spark.createDataFrame(samples.REPLIES, "n int, value string"), most=4).drop("description", "file").withColumn("reasoning", F.left("reasoning", F.lit(6)))


@_query(f"""WITH c AS (SELECT * FROM {samples.values(samples.CHANGES, 'file_path, operation, new_content')}), j AS (SELECT c.*, f.content FROM c LEFT JOIN {_FILES} f ON f.path = c.file_path),
l AS (SELECT operation, CASE operation WHEN 'create' THEN len(string_split(new_content, chr(10))) WHEN 'update' THEN len(list_filter(string_split(new_content, chr(10)), lambda x: NOT list_contains(string_split(content, chr(10)), x))) ELSE 0 END AS plus,
  CASE operation WHEN 'delete' THEN coalesce(len(string_split(content, chr(10))), 0) WHEN 'update' THEN len(list_filter(string_split(content, chr(10)), lambda x: NOT list_contains(string_split(new_content, chr(10)), x))) ELSE 0 END AS minus FROM j)
SELECT CAST(count(*) AS INT) AS total, CAST(count(*) FILTER (operation = 'update') AS INT) AS modified, CAST(count(*) FILTER (operation = 'create') AS INT) AS created, CAST(count(*) FILTER (operation = 'delete') AS INT) AS deleted, CAST(sum(plus) AS INT) AS additions, CAST(sum(minus) AS INT) AS deletions FROM l""")
def diff_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = tools.preview(_sample(spark), reports.changes(spark, samples.CHANGES))["summary"]
    return one.select(*[F.col(c).cast("int").alias(c) for c in ("total", "modified", "created", "deleted", "additions", "deletions")])


@_query(f"WITH {_CODE} SELECT path, CAST(count(*) AS INT) AS n FROM words WHERE name = 'fmt' GROUP BY path")
def reference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.reference_counts(_sample(spark).files, "fmt")


@_query(f"""WITH {_CODE}, own AS (SELECT name, count(*) AS k FROM words WHERE path = '/app/src/store.ts' GROUP BY name)
SELECT DISTINCT 'import' AS kind, i.name FROM named i LEFT JOIN own USING (name) WHERE i.path = '/app/src/store.ts' AND coalesce(k, 0) <= 1
UNION ALL SELECT DISTINCT 'export', name FROM exported WHERE path = '/app/src/store.ts' AND name NOT IN (SELECT name FROM words WHERE path <> '/app/src/store.ts')""")
def unused_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.unused_by_reference(_sample(spark).files, "/app/src/store.ts")


@_query(f"SELECT CAST(count(*) AS INT) AS total, CAST(count(*) FILTER (confidence = 'high') AS INT) AS high, CAST(count(*) FILTER (type = 'unused-export') AS INT) AS unused_export, CAST(count(*) FILTER (type = 'unused-import') AS INT) AS unused_import FROM ({_dead_sql(False)})")
def dead_code_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = tools.find_dead_code(_sample(spark), ["/app/src/main.ts"])["summary"]
    return one.select(*[F.col(c).cast("int").alias(c) for c in ("total", "high", "unused_export", "unused_import")])


@_query(f"""WITH RECURSIVE {_CODE}, {_graph_sql("impact")}, above(node) AS (SELECT src FROM links WHERE dst = '/app/src/util/format.ts' UNION SELECT src FROM above JOIN links ON dst = node),
near AS (SELECT DISTINCT src AS node FROM links WHERE dst = '/app/src/util/format.ts' AND src <> dst),
one AS (SELECT (SELECT count(*) FROM near) AS direct, (SELECT count(*) FROM above WHERE node NOT IN (SELECT node FROM near) AND node <> '/app/src/util/format.ts') AS transitive,
  CASE WHEN EXISTS (SELECT 1 FROM files WHERE path IN ('/app/src/util/format.test.ts', '/app/src/util/format.spec.ts', '/app/src/util/__tests__/format.test.ts')) THEN 80.0 ELSE 0.0 END::DOUBLE AS coverage,
  (SELECT {_COMPLEXITY.format('content')} FROM files WHERE path = '/app/src/util/format.ts') AS complexity)
SELECT CAST(direct AS BIGINT) AS direct, CAST(transitive AS BIGINT) AS transitive, coverage, least(100.0, round(direct * 5.0 + transitive * 2.0 + complexity * 2.0 + (100.0 - coverage) * 0.3))::DOUBLE AS risk,
  CASE WHEN least(100.0, round(direct * 5.0 + transitive * 2.0 + complexity * 2.0 + (100.0 - coverage) * 0.3)) > 70 THEN 'high' WHEN least(100.0, round(direct * 5.0 + transitive * 2.0 + complexity * 2.0 + (100.0 - coverage) * 0.3)) > 40 THEN 'medium' ELSE 'low' END AS risk_label FROM one""")
def impact_of_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.impact(_sample(spark), "/app/src/util/format.ts")["summary"].select("direct", "transitive", "coverage", "risk", "risk_label")


@_query(f"""WITH RECURSIVE {_CODE}, {_graph_sql("trace")}, fore(node, d) AS (SELECT '/app/src/util/format.ts', 0 UNION SELECT dst, d + 1 FROM fore JOIN links ON src = node WHERE d < 4), back(node, d) AS (SELECT '/app/src/util/format.ts', 0 UNION SELECT src, d + 1 FROM back JOIN links ON dst = node WHERE d < 4)
SELECT count(DISTINCT node) AS n_files FROM (SELECT node FROM fore UNION SELECT node FROM back)""")
def traced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.dependency_trace(_sample(spark), "/app/src/util/format.ts", unused=False)["summary"]


@_query(f"""WITH {_CODE} SELECT w.path, w.line, regexp_replace(c.raw, '\\bfmt\\b', 'show', 'g') AS text FROM words w JOIN clean c ON c.path = w.path AND c.line = w.line WHERE w.name = 'fmt'""")
def renamed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.rename(_sample(spark), "/app/src/util/format.ts", "fmt", "show")["references"]


@_query(f"SELECT parameters, call, return_type FROM ({_EXTRACT_SQL})")
def extracted_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_function(spark, sf_dir).select("parameters", "call", "return_type")


# the same operators at size: 10^5 files whose imports follow a rule

_MANY = 100_000


def _many_imports(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """File i lies in folder i mod 100 and imports files 2i + 1 and 2i + 2, but for every tenth file, which imports none."""
    path = lambda i: F.concat(F.lit("/p/d"), i % 100, F.lit("/f"), i, F.when(i % 3 == 0, F.lit(".tsx")).otherwise(F.lit(".ts")))
    files = spark.range(_MANY).select("id", path(F.col("id")).alias("path"))
    told = files.filter("id % 10 != 3").select("path", F.explode(F.array(F.col("id") * 2 + 1, F.col("id") * 2 + 2)).alias("j"))
    return files.select("path"), told.select("path", (F.col("j") % 2).cast("int").alias("ord"), F.concat(F.lit("../d"), F.col("j") % 100, F.lit("/x/../f"), F.col("j")).alias("source"))


_MANY_SQL = f"""files AS (SELECT i, '/p/d' || i % 100 || '/f' || i || CASE WHEN i % 3 = 0 THEN '.tsx' ELSE '.ts' END AS path FROM range({_MANY}) t(i)),
links AS (SELECT a.i AS i, a.path AS src, b.i AS j, b.path AS dst FROM (SELECT i, path, 2 * i + 1 AS j FROM files UNION ALL SELECT i, path, 2 * i + 2 FROM files) a JOIN files b ON b.i = a.j WHERE a.i % 10 <> 3)"""


@_query(f"WITH {_MANY_SQL} SELECT src, dst FROM links")
def resolve_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, imports = _many_imports(spark)
    return resolve.edges(resolve.resolve(imports, files, "graph"))


@_query(f"WITH RECURSIVE {_MANY_SQL}, reached(i, path, depth) AS (SELECT i, path, 0 FROM files WHERE i = 0 UNION ALL SELECT l.j, l.dst, depth + 1 FROM reached r JOIN links l ON l.i = r.i) SELECT path, CAST(depth AS INT) AS depth FROM reached")
def reach_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = resolve_many(spark, sf_dir)
    return graph.reachable(edges, spark.createDataFrame([("/p/d0/f0.tsx",)], "node string")).select(F.col("node").alias("path"), "depth")


@_query(f"WITH RECURSIVE {_MANY_SQL}, reached(i) AS (SELECT CAST(0 AS BIGINT) UNION ALL SELECT l.j FROM reached r JOIN links l ON l.i = r.i) SELECT path FROM files WHERE i NOT IN (SELECT i FROM reached)")
def unreached_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that nothing reaches from the first one."""
    return _many_imports(spark)[0].join(reach_many(spark, sf_dir).select("path"), "path", "left_anti")
