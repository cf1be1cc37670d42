"""The code operators over a corpus that Spark derives from the tables: one source file a supplier.

Supplier k of nation n is the file ``/s/n<n>/f<k>.ts``.  It imports the suppliers that it shares most orders with, uses the
first of them, exports a constant and has a private function; so all that a tool says of it follows from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import findings, resolve
from ..operators import symbols as sym
from ..operators.scripts import BUILT_IN, parsed
from ..sources import corpus as source
from ..sources import reports
from ..storage import durable
from . import tools
from .corpus import Corpus
from .registry import _COMPLEXITY, _EDGES, _LANG_SQL, _RULES, Query, _edges, _table

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _corpus(spark: SparkSession, sf_dir: str, mode: str = "reference") -> Corpus:
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    other = s.select(F.col("k").alias("dst"), F.col("n").alias("m"))
    told = _edges(spark, sf_dir).join(other, "dst").groupBy(F.col("src").alias("k")).agg(F.array_sort(F.collect_list(F.struct("dst", "m"))).alias("to"))  # two a supplier
    rows = s.join(told, "k", "left").withColumn("to", F.coalesce("to", F.array().cast("array<struct<dst:bigint,m:bigint>>")))
    imports = F.array_join(F.transform("to", lambda x: F.format_string("import { s_%d } from '../n%d/f%d';\n", x["dst"], x["m"], x["dst"])), "")
    value = F.when(F.size("to") > 0, F.format_string("s_%d ? 1 : 0", F.get("to", F.lit(0))["dst"])).otherwise("0")
    body = F.format_string("export const s_%d = %s;\nfunction _h_%d(x) {\n  if (x > 0 && s_%d) {\n    return x;\n  }\n  return 0;\n}\n", F.col("k"), value, F.col("k"), F.col("k"))
    path = F.format_string("/s/n%d/f%d.ts", F.col("n"), F.col("k"))
    content = F.concat(imports, body)
    read = rows.select(path.alias("path"), F.expr("substring(format_string('/s/n%d/f%d.ts', n, k), 4)").alias("relative_path"), F.octet_length(content).cast("bigint").alias("size"), F.lit(None).cast("timestamp").alias("last_modified"), content.alias("content"))
    return Corpus(durable(source.with_metrics(read), "files"), mode)


_FILES = rf"""{_EDGES}, told AS (
  SELECT e.src AS k, list({{'dst': e.dst, 'm': s.s_nationkey}} ORDER BY e.dst) AS t FROM edges e JOIN supplier s ON s.s_suppkey = e.dst GROUP BY e.src
), files AS (
  SELECT s_suppkey AS k, coalesce(t, []) AS t, '/s/n' || s_nationkey || '/f' || s_suppkey || '.ts' AS path,
    array_to_string(list_transform(coalesce(t, []), lambda x: 'import {{ s_' || x.dst || ' }} from ''../n' || x.m || '/f' || x.dst || ''';' || chr(10)), '')
    || 'export const s_' || s_suppkey || ' = ' || CASE WHEN len(coalesce(t, [])) > 0 THEN 's_' || t[1].dst || ' ? 1 : 0' ELSE '0' END || ';' || chr(10) || 'function _h_' || s_suppkey || '(x) {{' || chr(10)
    || '  if (x > 0 && s_' || s_suppkey || ') {{' || chr(10) || '    return x;' || chr(10) || '  }}' || chr(10) || '  return 0;' || chr(10) || '}}' || chr(10) AS content
  FROM supplier LEFT JOIN told ON told.k = s_suppkey
), links AS (SELECT a.path AS src, b.path AS dst, e.src AS k, e.dst AS j FROM edges e JOIN files a ON a.k = e.src JOIN files b ON b.k = e.dst)"""


@_query(rf"""WITH {_FILES} SELECT path, 's_' || k AS name, 'variable' AS type, CAST(len(t) + 1 AS INT) AS start_line, CAST(len(t) + 1 AS INT) AS end_line, true AS is_exported, false AS is_private FROM files
UNION ALL SELECT path, '_h_' || k, 'function', CAST(len(t) + 2 AS INT), CAST(len(t) + 7 AS INT), false, true FROM files""")
def supplier_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of each file."""
    return _corpus(spark, sf_dir, "corrected").symbols.select("path", "name", "type", "start_line", "end_line", "is_exported", "is_private")


@_query(f"WITH {_FILES} SELECT path, CAST(i - 1 AS INT) AS ord, '../n' || t[i].m || '/f' || t[i].dst AS source FROM files, range(1, 3) r(i) WHERE i <= len(t)")
def supplier_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of each file."""
    return _corpus(spark, sf_dir).imports


@_query(f"WITH {_FILES} SELECT rule, src, dst FROM links, (SELECT unnest(['graph', 'context', 'impact', 'trace', 'dead_code']) AS rule)")
def supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports resolved by each rule."""
    corpus, out = _corpus(spark, sf_dir), None
    for rule in resolve.RULES:
        one = corpus.edges(rule).select(F.lit(rule).alias("rule"), "src", "dst")
        out = one if out is None else out.unionByName(one)
    return out


@_query(rf"""WITH {_FILES} SELECT path, substr(path, 4) AS relative_path, {_LANG_SQL.format('path')} AS language, CAST(len(t) + 8 AS INT) AS n_lines, CAST({_COMPLEXITY.format('content')} AS INT) AS complexity,
  CAST(CASE WHEN len(t) > 0 THEN 4 ELSE 3 END AS INT) AS decisions, array_to_string(list_slice(string_split(content, chr(10)), 2, 3), chr(10)) AS second_and_third, regexp_replace(path, '/[^/]*$', '') AS folder,
  '../n' || k % 3 || '/f' || k || '.ts' AS seen_from FROM files""")
def supplier_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, P3, M1, M4, X13 and path algebra: measures of each file."""
    files = _corpus(spark, sf_dir).files
    k = F.regexp_extract("path", r"f(\d+)\.ts$", 1)
    elsewhere = fx.relative_path(F.concat(F.lit("/s/n"), F.pmod(k.cast("long"), F.lit(3)).cast("string"), F.lit("/f"), k, F.lit(".ts")), F.lit("/s/other"))
    return files.select("path", "relative_path", "language", "n_lines", "complexity", fx.function_complexity(F.col("content")).alias("decisions"), fx.line_range(F.col("content"), F.lit(2), F.lit(3)).alias("second_and_third"), fx.dirname(F.col("path")).alias("folder"), elsewhere.alias("seen_from"))


@_query(f"WITH {_FILES} SELECT count(*) AS n_files, 2 * count(*) AS n_symbols, CAST(sum(octet_length(encode(content))) AS BIGINT) AS total_size, avg({_COMPLEXITY.format('content')}) AS average_complexity, CAST(0 AS BIGINT) AS n_tests FROM files")
def supplier_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: one row over all files."""
    return _corpus(spark, sf_dir, "corrected").stats().select("n_files", "n_symbols", "total_size", "average_complexity", "n_tests")


_ENTRY = "(SELECT path FROM files ORDER BY k LIMIT 1)"


def _entry(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    first = _table(spark, sf_dir, "supplier").orderBy("s_suppkey").select("s_suppkey", "s_nationkey").first()
    return f"/s/n{first[1]}/f{first[0]}.ts", first[0]


@_query(f"""WITH RECURSIVE {_FILES}, reached(node) AS (SELECT {_ENTRY} UNION SELECT dst FROM reached JOIN links ON src = node)
SELECT path, CAST(1 AS INT) AS line, CAST(NULL AS VARCHAR) AS symbol, 'unused-export' AS type, 'high' AS severity FROM files WHERE path NOT IN (SELECT node FROM reached)
UNION ALL SELECT path, 2, 's_' || t[2].dst, 'unused-import', 'low' FROM files WHERE len(t) = 2 AND path IN (SELECT node FROM reached)""")
def supplier_dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the first supplier's doesn't reach, and imports that a reached file doesn't use."""
    path, _ = _entry(spark, sf_dir)
    return tools.find_dead_code(_corpus(spark, sf_dir), [path])["findings"].select("path", "line", "symbol", "type", "severity")


@_query(f"""WITH RECURSIVE {_FILES}, above(node) AS (SELECT src FROM links WHERE dst = {_ENTRY} UNION SELECT src FROM above JOIN links ON dst = node),
near AS (SELECT DISTINCT src AS node FROM links WHERE dst = {_ENTRY} AND src <> dst),
n AS (SELECT (SELECT count(*) FROM near) AS direct, (SELECT count(*) FROM above WHERE node NOT IN (SELECT node FROM near) AND node <> {_ENTRY}) AS transitive, (SELECT {_COMPLEXITY.format('content')} FROM files WHERE path = {_ENTRY}) AS c)
SELECT CAST(direct AS BIGINT) AS direct, CAST(transitive AS BIGINT) AS transitive, least(100.0, round(direct * 5.0 + transitive * 2.0 + c * 2.0 + 100.0 * 0.3))::DOUBLE AS risk FROM n""")
def supplier_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on the first supplier's file, and the risk of a change."""
    return tools.impact(_corpus(spark, sf_dir), _entry(spark, sf_dir)[0])["summary"].select("direct", "transitive", "risk")


@_query(rf"""WITH {_FILES}, l AS (SELECT path, unnest(string_split(content, chr(10))) AS text, unnest(range(len(string_split(content, chr(10))))) + 1 AS line FROM files),
name AS (SELECT 's_' || min(k) AS name FROM files),
uses AS (SELECT path, line, text, name, len(regexp_extract_all(text, '\b' || name || '\b')) AS n FROM l, name)
SELECT path, CAST(line AS INT) AS line, regexp_replace(text, '\b' || name || '\b', 'renamed', 'g') AS text FROM uses, range(1, 9) r(i) WHERE i <= n""")
def supplier_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11, T5: the first supplier's name renamed everywhere; files come from the index of names."""
    path, k = _entry(spark, sf_dir)
    return tools.rename(_corpus(spark, sf_dir), path, f"s_{k}", "renamed", indexed=True)["references"]


@_query(r"""SELECT page_id, regexp_extract(body, '\bvar\s+(\w+)', 1) AS name, 'variable' AS type, CAST(len(regexp_extract_all(body, '\btrack\b')) AS INT) AS n_track
FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1)) AS body FROM pages)""")
def page_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations in the scripts of pages, and how often each refers to a name."""
    bodies = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<script>(.*?)</script>"), 1)).alias("pos", "content"))
    files = durable(bodies.select("page_id", F.format_string("/p%d/%d.js", "page_id", "pos").alias("path"), "content").withColumn("language", fx.language(F.col("path"))), "scripts")
    found = parsed(files, ("symbols", "identifiers"), "corrected")
    told = found.select("path", F.explode("symbols").alias("s"), F.size(F.filter("identifiers", lambda x: x["name"] == "track")).alias("n_track"))
    return told.join(files.select("path", "page_id"), "path").select("page_id", F.col("s.name").alias("name"), F.col("s.type").alias("type"), "n_track")


# readers of reports, over texts made from customers and orders: S6, S7, S11, S12


@_query("""SELECT '/c/f' || o_custkey || '.ts' AS path, CAST(count(*) FILTER (o_orderkey % 4 > 0) AS INT) AS covered, CAST(count(*) AS INT) AS total, 100.0 * count(*) FILTER (o_orderkey % 4 > 0) / count(*) AS pct,
  CAST(count(*) FILTER (o_orderkey % 4 = 0 AND o_orderkey % 300 > 0) AS INT) AS n_regions, count(*) FILTER (o_orderkey % 4 = 0 AND o_orderkey % 300 > 0) > 0 AS missing FROM orders GROUP BY o_custkey""")
def order_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON report a customer, whose statements are the customer's orders."""
    k = F.col("o_orderkey")
    one = F.struct(k.cast("string"), F.struct(F.struct((k % 300).cast("int").alias("line")).alias("start")))
    hits = F.struct(k.cast("string"), (k % 4).alias("n"))
    body = F.struct(F.map_from_entries(F.collect_list(one)).alias("statementMap"), F.map_from_entries(F.collect_list(hits)).alias("s"))
    path = F.format_string("/c/f%d.ts", "o_custkey")
    told = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(body.alias("body"))  # a customer has few orders
    told = told.select(F.to_json(F.struct(F.create_map(path, "body").alias("coverageMap"))).alias("value"))
    return reports.coverage_json(told).select("path", "covered", "total", "pct", F.size("regions").alias("n_regions"), "missing")


@_query("SELECT '/c/f' || c_custkey || '.ts' AS path, CAST(c_custkey % 101 AS DOUBLE) AS pct, c_custkey % 101 < 100 AS missing FROM customer")
def customer_coverage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a coverage table, among rules and headings."""
    k = F.col("c_custkey")
    row = F.format_string(" /c/f%d.ts   |   %d |  50.5 |  1 |  %d.25 | 7", k, k % 101, k % 7)
    lines = _table(spark, sf_dir, "customer").select(F.explode(F.array(F.lit("File | % Stmts | % Branch"), row, F.lit("-----|-----|----"))).alias("value"))
    return reports.coverage_text(lines).select("path", "pct", "missing")


@_query("""SELECT o_orderkey AS n, 'lint' AS type, o_orderpriority || ' is late' AS message, '/o/f' || o_custkey || '.ts' AS file, CAST(o_orderkey % 500 AS INT) AS line FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey, 'typescript', 'Type ' || o_orderpriority, '/o/f' || o_custkey || '.ts', CAST(o_orderkey % 70 AS INT) FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, 'test', 'FAIL f' || o_custkey, NULL, NULL FROM orders WHERE o_orderstatus = 'O'""")
def order_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three tools' logs, all of them kept."""
    o, k = _table(spark, sf_dir, "orders"), F.col("o_orderkey")
    status, file = F.col("o_orderstatus"), F.format_string("/o/f%d.ts", "o_custkey")
    said = {
        "lint": F.when(status == "P", F.lit("all is well")).otherwise(F.concat(file, F.format_string(":%d:3  ", k % 500), F.when(status == "F", "error").otherwise("warning"), F.lit("  "), "o_orderpriority", F.lit(" is late"))),
        "typescript": F.when(status == "F", F.concat(file, F.format_string("(%d,7): error TS2322: Type ", k % 70), "o_orderpriority")).otherwise("Found no more"),
        "test": F.when(status == "O", F.concat(F.lit("  FAIL f"), "o_custkey", F.lit("  "))).otherwise("ok"),
    }
    out = None
    for kind, value in said.items():
        one = reports.log_errors(o.select(k.alias("n"), value.alias("value")), kind, most=2**31 - 1)
        out = one if out is None else out.unionByName(one)
    return out


@_query(rf"""WITH f AS (SELECT o_orderkey AS n, o_orderpriority AS title, CAST(o_orderkey % 100 AS DOUBLE) AS told FROM orders WHERE o_orderstatus <> 'P'), r AS (SELECT *, CASE WHEN told = 0 THEN 50.0 ELSE told END AS risk FROM f)
SELECT n, 'suggestion-1' AS id, 'unknown' AS type, title, CAST(n % 9 AS INT) AS start_line, CASE {' '.join(f"WHEN risk < {b} THEN '{t}'" for b, t in reports.IMPACTS[:-1])} ELSE '{reports.IMPACTS[-1][1]}' END AS estimated_impact, risk AS risk_score FROM r
UNION ALL SELECT o_orderkey, 'error-1', 'analysis-error', 'Unable to parse suggestions', 0, 'Unknown', 0.0 FROM orders WHERE o_orderstatus = 'P'""")
def order_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply an order, fenced, bare or without JSON."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    item = F.struct(F.col("o_orderpriority").alias("title"), (k % 100).cast("double").alias("riskScore"), (k % 9).alias("startLine"))
    text = F.to_json(F.struct(F.array(item).alias("suggestions")))
    value = F.when(status == "F", F.concat(F.lit("Here:\n```json\n"), text, F.lit("\n```\nDone."))).when(status == "O", text).otherwise("I am sorry.")
    found = tools.suggestions(_table(spark, sf_dir, "orders").select(k.alias("n"), value.alias("value")))
    return found.select("n", "id", "type", "title", "start_line", "estimated_impact", "risk_score")


# other languages, over a file of each a part: X3 to X6, P9


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    python = F.format_string("import os\nfrom m%d.core import x\nclass C%d:\n    def run(self):\n        pass\nasync def _p%d(a):\n    return a\n", F.col("k") % 50, "k", "k")
    go = F.format_string("package p\nimport (\n\t\"fmt\"\n\t\"m%d/core\"\n)\nfunc F%d() {}\nfunc g%d(x int) {}\ntype T%d struct {}\n", F.col("k") % 50, "k", "k", "k")
    both = p.select(F.explode(F.array(F.struct(F.format_string("/p/f%d.py", "k").alias("path"), python.alias("content")), F.struct(F.format_string("/p/f%d.go", "k").alias("path"), go.alias("content")))).alias("x")).select("x.*")
    read = both.select("path", "path", F.octet_length("content").cast("bigint").alias("size"), F.lit(None).cast("timestamp").alias("last_modified"), "content").toDF("path", "relative_path", "size", "last_modified", "content")
    return source.with_metrics(read)


@_query("""SELECT '/p/f' || p_partkey || x.e AS path, x.name || CASE WHEN x.name = 'run' THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS name, x.type, x.line AS start_line, x.shown AS is_exported, x.own AS is_private
FROM part, (VALUES ('.py', 'C', 'class', 3, true, false), ('.py', 'run', 'function', 4, true, false), ('.py', '_p', 'function', 6, true, true), ('.go', 'F', 'function', 6, true, false), ('.go', 'g', 'function', 7, false, true), ('.go', 'T', 'type', 8, true, false)) x(e, name, type, line, shown, own)""")
def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of Python and Go files."""
    return sym.symbols(_parts(spark, sf_dir)).select("path", "name", "type", "start_line", "is_exported", "is_private")


@_query("""SELECT '/p/f' || p_partkey || x.e AS path, x.ord, replace(x.source, '#', CAST(p_partkey % 50 AS VARCHAR)) AS source FROM part, (VALUES ('.py', 0, 'os'), ('.py', 1, 'm#.core'), ('.go', 0, 'fmt'), ('.go', 1, 'm#/core')) x(e, ord, source)""")
def part_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of Python and Go files."""
    return sym.imports(_parts(spark, sf_dir))


@_query(r"""WITH t AS (SELECT '/t/' || p_partkey || (['/a.types.ts', '/a.d.ts', '/types.tsx', '/mytypes.ts', '/a.types.js'])[p_partkey % 5 + 1] AS path FROM part) SELECT path, regexp_matches(path, '[.]types[.]tsx?$') OR regexp_matches(path, '[.]d[.]ts$') OR regexp_matches(path, '(^|/)types[.]tsx?$') AS type_only FROM t""")
def part_type_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that hold types alone, by their names."""
    ends = F.array(*[F.lit(x) for x in ("/a.types.ts", "/a.d.ts", "/types.tsx", "/mytypes.ts", "/a.types.js")])
    path = F.concat(F.lit("/t/"), "p_partkey", F.get(ends, (F.col("p_partkey") % 5).cast("int")))
    return _table(spark, sf_dir, "part").select(path.alias("path")).select("path", fx.is_type_only(F.col("path")).alias("type_only"))


@_query(rf"""WITH l AS (SELECT doc_id, regexp_extract_all(string_split(text, chr(10))[1], '[A-Za-z_]+') AS used, regexp_extract_all(coalesce(string_split(text, chr(10))[2], ''), '[A-Za-z_]+') AS declared FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(used), lambda x: NOT list_contains(declared, x) AND x NOT IN ({', '.join(f"'{b}'" for b in BUILT_IN)}))), ',') AS names FROM l""")
def document_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each document's first line that its second lacks."""
    word = F.lit("[A-Za-z_]+")
    line = lambda k: F.coalesce(F.get(fx.lines(F.col("text")), F.lit(k)), F.lit(""))
    used, declared = F.regexp_extract_all(line(0), word, F.lit(0)), F.regexp_extract_all(line(1), word, F.lit(0))
    d = _table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", F.array_join(fx.free_names(used, declared, F.array(*map(F.lit, BUILT_IN))), ",").alias("names"))


@_query(f"""WITH c AS (SELECT o_custkey AS k, '/c/f' || o_custkey || '.js' AS path, CAST(3 * count(*) AS INT) AS n FROM orders GROUP BY o_custkey), measured AS (
  SELECT path, 'file-too-large' AS type, CAST(NULL AS VARCHAR) AS symbol, CAST(NULL AS INT) AS start_line, CAST(NULL AS INT) AS end_line, n + 4 AS current FROM c
  UNION ALL SELECT path, 'function-too-long', 'f' || k, 1, n + 3, n + 3 FROM c
  UNION ALL SELECT path, 'function-too-complex', 'f' || k, 1, n + 3, n + 1 FROM c
), judged AS (
  SELECT m.*, unit, CAST(medium AS INT) AS threshold, pos, CASE WHEN current > high THEN 'high' ELSE 'medium' END AS severity,
    CASE WHEN current > high THEN effort_high ELSE effort_low END AS effort, CASE WHEN current > high THEN impact_high ELSE impact_low END AS impact
  FROM measured m JOIN {_RULES} r ON r.type = m.type WHERE current > medium
)
SELECT 'opp-' || row_number() OVER (ORDER BY severity <> 'high', CASE impact WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, path, pos, start_line, type) AS id,
  path, type, severity, symbol, start_line, end_line, current, threshold, unit, effort, impact FROM judged""")
def customer_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, O1: a function a customer, three branches for each order."""
    n = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg((3 * F.count(F.lit(1))).cast("int").alias("n"))
    content = F.concat(F.format_string("function f%d(x) {\n", "o_custkey"), F.repeat(F.lit("  if (x > 1) { x = x - 1; }\n"), F.col("n")), F.lit("  return x;\n}\n"))
    path = F.format_string("/c/f%d.js", "o_custkey")
    read = n.select(path.alias("path"), path.alias("relative_path"), F.octet_length(content).cast("bigint").alias("size"), F.lit(None).cast("timestamp").alias("last_modified"), content.alias("content"))
    c = Corpus(durable(source.with_metrics(read), "files"))
    return findings.opportunities(c.files, c.symbols).select("id", "path", "type", "severity", "symbol", "start_line", "end_line", "current", "threshold", "unit", "effort", "impact")
