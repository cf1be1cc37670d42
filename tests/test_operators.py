import random

import pytest
from pyspark.sql import functions as F

from quillspan.functions import scores
from quillspan.operators import diffs, findings, graph, reach, refactor, scripts, types
from quillspan.operators import symbols as sym
from quillspan.plans import report, samples, tools
from quillspan.plans.corpus import Corpus, invalidate, open_corpus
from quillspan.sources import corpus as source
from quillspan.sources import reports


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus(source.from_rows(spark, samples.FILES, samples.ROOT))


def test_scan(spark, tmp_path):
    for name, body in {"src/a.ts": "import b from './b'", "src/b.js": "", "node_modules/x.js": "x", "src/c.java": "class C {}", "src/d.min.js": "", "src/big.py": "#" * 200, "out/e.go": "package e"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    (tmp_path / ".git").mkdir()
    (tmp_path / ".gitignore").write_text("# made\n/out/\n")
    got = source.scan(spark, str(tmp_path), max_file_size=100)
    assert [r[0] for r in got.orderBy("path").select("relative_path").collect()] == ["src/a.ts", "src/b.js"]
    assert source.scan(spark, str(tmp_path), max_files=1, max_file_size=100).count() == 1
    c = open_corpus(spark, str(tmp_path), max_file_size=100)
    assert open_corpus(spark, str(tmp_path), max_file_size=100) is c and open_corpus(spark, str(tmp_path)) is not c
    assert invalidate(str(tmp_path)) == 2


def test_globs():
    import re

    match = lambda g, p: bool(re.fullmatch(source.glob_regex(g), p))
    assert match("**/*.ts", "a.ts") and match("**/*.ts", "x/y/a.ts") and not match("**/*.ts", "a.tsx")
    assert match("**/dist/**", "a/dist/b/c.js") and match("**/dist/**", "dist/c.js") and not match("**/dist/**", "adist/c.js")
    assert source.ignore_globs(["/a/", "b", "", "#c", "d/**", "!e"]) == ["**/a/**", "**/b", "d/**", "**/!e"]


def test_script_symbols(corpus):
    rows = {(r.path.split("/")[-1], r.name): r for r in sym.script_symbols(corpus.files).collect()}
    main = rows["main.ts", "main"]
    assert (main.type, main.start_line, main.end_line, main.is_exported, main.parameters, main.return_type) == ("function", 5, 14, True, ["argv"], "number")
    assert rows["store.ts", "load"].type == "variable" and rows["model.ts", "Key"].type == "type" and rows["format.ts", "_hidden"].is_private
    assert rows["lost.tsx", "Page"].is_exported
    hundred = "".join(f"export function f{k}(a, b) {{ return `${{a}}` + '}}' + /[}}]/.source; }}\n" for k in range(100))
    assert len(scripts.symbol_rows(hundred)) == 100
    assert scripts.symbol_rows("export default function () {}\nconst a = 1;") == [] and len(scripts.symbol_rows("export default function () {}\nconst a = 1;", "corrected")) == 1
    assert [r["name"] for r in scripts.symbol_rows("const a = 'x';\nfunction b() {")] == ["b", "a"] and scripts.symbol_rows("") == []


def test_blanking_keeps_places():
    code = "a = 'x{'; // {\n/* { */ b = `t ${ {c: 1}.c } {`; d = 4 / 2 / 1; e = /[/}]/g\n"
    clean, ended = scripts.blanked(code)
    assert ended and len(clean) == len(code) and clean.count("{") == 1 and "/ 2 /" in clean
    assert [x["name"] for x in scripts.identifiers("a.b = class_ + 'c' // d")] == ["a", "b", "class_"]


def test_index_stats(corpus):
    one = sym.index_stats(sym.with_symbols(corpus.files)).first()
    assert one.n_files == 11 and one.n_tests == 1 and one.by_language["typescript"] == 7
    empty = sym.index_stats(sym.with_symbols(corpus.files.limit(0))).first()
    assert (empty.n_files, empty.average_complexity, empty.by_language) == (0, 0.0, {})


def random_graph(seed, n=12, m=20):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


@pytest.mark.parametrize("seed", [1, 2])
def test_graph_against_brute_force(spark, seed):
    pairs = random_graph(seed)
    e = spark.createDataFrame(pairs, "src bigint, dst bigint")
    out = {a: {y for x, y in pairs if x == a} for a in range(12)}

    def depths(a):
        seen, level, d = {a: 0}, {a}, 0
        while level:
            d += 1
            level = {y for x in level for y in out[x]} - seen.keys()
            seen |= dict.fromkeys(level, d)
        return seen

    seeds = spark.createDataFrame([(0,)], "node bigint")
    assert {r.node: r.depth for r in graph.reachable(e, seeds).collect()} == depths(0)
    full = {(a, b) for a in range(12) for c in out[a] for b in depths(c)}
    assert {(r.a, r.b) for r in graph.closure(e).collect()} == full
    assert {r.node for r in graph.cycle_members(e).collect()} == {a for a, b in full if a == b}
    back = {a for a, b in full if b == 0}
    direct = {a for a, b in pairs if b == 0}
    assert {r.node for r in graph.transitive_dependents(e, 0).collect()} == back - direct - {0}
    chains = graph.chains(e, 0, 3).collect()
    assert {r.path[-1] for r in chains} | {0} >= {k for k, d in depths(0).items() if d <= 4}
    assert all(r.depth == len(r.path) - 1 <= 4 and all((a, b) in pairs for a, b in zip(r.path, r.path[1:], strict=False)) for r in chains)
    gone = spark.createDataFrame([(3,), (4,)], "node bigint")
    assert {tuple(r) for r in graph.without(e, gone).collect()} == {p for p in pairs if not {3, 4} & set(p)}

    def simple(path):
        for y in out[path[-1]]:
            if y == path[0]:
                yield [*path, y]
            elif y > path[0] and y not in path:
                yield from simple([*path, y])

    want = {tuple(c) for a in depths(0) for c in simple([a])}
    assert {tuple(r.files) for r in graph.cycles(e, 0, 12).collect()} == want


def test_circular_imports_need_corrected_mode(spark):
    rows = [("/p/A.ts", "import { b } from './B.js';"), ("/p/B.ts", "import { a } from './A.js';"), ("/p/C.ts", "import { a } from './A.js';\nimport { b } from './B.js';")]
    assert Corpus(source.from_rows(spark, rows)).edges().count() == 0
    fixed = Corpus(source.from_rows(spark, rows), "corrected")
    assert {tuple(r) for r in fixed.edges().collect()} == {("/p/A.ts", "/p/B.ts"), ("/p/B.ts", "/p/A.ts"), ("/p/C.ts", "/p/A.ts"), ("/p/C.ts", "/p/B.ts")}
    cycle = graph.cycles(fixed.edges(), "/p/C.ts").collect()
    assert [(r.files, r.severity) for r in cycle] == [(["/p/A.ts", "/p/B.ts", "/p/A.ts"], "medium")]
    less = fixed.without(["/p/B.ts"])
    assert {tuple(r) for r in less.edges().collect()} == {("/p/C.ts", "/p/A.ts")}


def test_folder_shadows_file_for_dead_code(spark):
    rows = [("/p/a.ts", "import x from './x'"), ("/p/x.ts", ""), ("/p/x/index.ts", "")]
    c = Corpus(source.from_rows(spark, rows))
    assert {r.dst for r in c.edges("graph").collect()} == {"/p/x.ts"}
    assert c.edges("dead_code").count() == 0


def test_opportunities(spark):
    body = "function long() {\n" + "  if (a && b) { x(); }\n" * 120 + "}\n" + "\n" * 400
    c = Corpus(source.from_rows(spark, [("/p/a.ts", body), ("/p/b.py", "\n" * 900)]))
    rows = tools.analyze(c)["opportunities"].collect()
    assert [(r.id, r.type, r.severity, r.current) for r in rows] == [("opp-1", "file-too-large", "high", 523), ("opp-2", "function-too-complex", "high", 241), ("opp-3", "function-too-long", "high", 122)]
    classes = spark.createDataFrame([("p", "C", "class", 1, 50)] + [("p", f"m{k}", "function", k, k) for k in range(2, 20)] + [("p", "out", "function", 60, 61)], "path string, name string, type string, start_line int, end_line int")
    assert findings.methods_in_classes(classes).first().n_methods == 18


def test_dead_code(corpus, spark):
    got = tools.find_dead_code(corpus, ["/app/src/main.ts"])
    rows = {(r.type, r.path.split("/")[-1], r.symbol) for r in got["findings"].collect()}
    assert ("unused-export", "orphan.js", None) in rows and ("unused-import", "store.ts", "unused") in rows and ("unused-export", "lost.tsx", "default") in rows
    fixed = tools.find_dead_code(Corpus(corpus.files, "corrected"), ["/app/src/main.ts"])
    assert ("unused-export", "format.ts", "WIDE") in {(r.type, r.path.split("/")[-1], r.symbol) for r in fixed["findings"].collect()}
    assert got["summary"].first().total == len(rows) and got["safe"].count() <= 20
    assert {tuple(r) for r in findings.unused_by_reference(corpus.files, "/app/src/util/format.ts").collect()} == {("export", "WIDE")}


def test_trace_impact_and_health(corpus):
    trace = tools.dependency_trace(corpus, "/app/src/main.ts")
    assert trace["forward"].count() >= 4 and trace["backward"].count() == 1
    one = tools.impact(corpus, "/app/src/util/format.ts")["summary"].first()
    assert (one.direct, one.transitive, one.risk) == (2, 2, 2 * 5 + 2 * 2 + 2 * 2 + 30)
    health = tools.project_health(corpus).first()
    assert health.n_files == 11 and 0 <= health.score <= 100
    said = report.markdown("Impact", tools.impact(corpus, "/app/src/util/format.ts"))
    assert said.startswith("# Impact") and "## direct" in said
    assert report.as_json(tools.test_ratio(corpus)).first().value.startswith('{"n_tests":1')


def apply(old, text):
    """The new lines, by walking a diff without context limits."""
    return [x[1:] for x in text if x[:1] in " +"]


def test_diffs_round_trip():
    rng = random.Random(9)
    for _ in range(200):
        old, new = ([rng.choice("abcde") for _ in range(rng.randint(1, 12))] for _ in range(2))
        changes = diffs.line_changes(old, new)
        assert [c[3] for c in changes if c[0] != "+"] == old and [c[3] for c in changes if c[0] != "-"] == new
        text, plus, minus = diffs.unified("p", "update", "\n".join(old), "\n".join(new))
        assert plus == sum(c[0] == "+" for c in changes) and minus == sum(c[0] == "-" for c in changes)
        assert (text.count("@@ -") > 0) == (old != new)


def test_diff_rules(spark, corpus):
    assert [c[0] for c in diffs.line_changes(["a", "b"], ["x", "a", "b"])] == ["+", " ", " "]
    old = "\n".join("abcdefghij")
    text, plus, minus = diffs.unified("p", "update", old, old.replace("e", "E"))
    assert text.endswith("@@ -2,5 +2,5 @@\n b\n c\n d\n-e\n+E\n f\n") and (plus, minus) == (1, 1)
    changes = reports.changes(spark, [("/app/config.ts", "update", "export const on = false;\n"), ("/app/new.ts", "create", "a\nb"), ("/app/none.ts", "delete", None), ("/app/README.md", "delete", None)])
    got = tools.preview(corpus, changes)
    one = got["summary"].first()
    assert (one.total, one.modified, one.created, one.deleted, one.additions, one.deletions) == (4, 1, 1, 2, 3, 3)
    with pytest.raises(ValueError):
        reports.changes(spark, [("a", "move", None)])


def test_rename_and_extract(corpus):
    got = tools.rename(corpus, "/app/src/util/format.ts", "fmt", "show")
    assert {(r.path.split("/")[-1], r.n) for r in got["summary"].collect()} == {("main.ts", 2), ("store.ts", 2), ("format.ts", 1)}
    assert got["symbol"].first().kind == "function" and "export function show(x: string) {" in [r.text for r in got["references"].collect()]
    assert tools.rename(corpus, "/app/src/util/format.ts", "fmt", "show", "file")["references"].count() == 1
    one = tools.extract(corpus, "/app/src/main.ts", 9, 11, "each").first()
    assert one.parameters == ["argv", "fmt"] and one.call == "each(argv, fmt);"
    assert refactor.extraction("a = 1;\nx = a + Math.PI;\nuse(x);", 1, 2, "f")["return_variable"] == "x"
    assert refactor.extraction("const q = 1;\nreturn q + z;", 1, 2, "f", "method")["signature"].startswith("f(z: any): any {")


def test_types(spark):
    code = "import a from 'a';\nimport {\n  b,\n} from 'b';\n\nexport interface One {\n  x: '}' | Two;\n}\ntype Two = string;\ndeclare global {\n  interface Window { y: 1 }\n}\n// interface No {\ninterface Gen<T> {}\nconst f = function () { type X = 1; };\n" + "\n" * 100
    assert [(d[0], d[2], d[3]) for d in types.definitions(code)] == [("One", 5, 7), ("Two", 8, 8)]
    assert types.definitions(code)[1][1] == "export type Two = string;"
    c = Corpus(source.from_rows(spark, [("/p/a.ts", code), ("/p/b.types.ts", code), ("/p/small.ts", "interface S {}\n")]))
    got = tools.type_abstraction(c)
    assert {r.target_file for r in got["found"].collect()} == {"/p/One.types.ts", "/p/Two.types.ts"}
    changes = {r.file_path: r.new_content for r in got["changes"].collect()}
    head = changes["/p/a.ts"].split("\n")
    assert head[4:7] == ["import type { Two } from './Two.types';", "import type { One } from './One.types';", "export type { One } from './One.types';"] and "interface One" not in changes["/p/a.ts"]
    assert changes["/p/One.types.ts"].startswith("import { Two } from './Two.types';\n\nexport interface One")


def test_reports(spark):
    text = spark.createDataFrame([("File | % | % | % | %",), ("src/a.ts  | 85.5 | 80 | 90 | 85.5 | 10-15",)], "value string")
    assert [(r.path, r.pct, r.missing) for r in reports.coverage_text(text).collect()] == [("src/a.ts", 85.5, True)]
    assert reports.coverage_json(spark.createDataFrame([("{}",), ("no json",), (None,)], "value string")).count() == 0
    one = reports.coverage_json(spark.createDataFrame([(samples.COVERAGE,)], "value string")).orderBy("path").first()
    assert [r.start_line for r in one.regions] == [9, 12]
    logs = spark.createDataFrame([(1, "all well")], "n int, value string")
    assert [(r.n, r.message) for r in reports.log_errors(logs, "lint").collect()] == [(-1, "lint failed")]
    many = spark.createDataFrame([(k, f"FAIL {k}") for k in range(30)], "n int, value string")
    assert reports.log_errors(many, "test").count() == 10
    replies = spark.createDataFrame([('Here:\n```json\n{"suggestions": [{"title": "A"}, {"description": "b", "priority": "high", "riskScore": 10}]}\n```',)], "value string")
    assert [(r.id, r.title, r.type, r.priority, r.risk_score) for r in reports.suggestions(replies).collect()] == [("suggestion-1", "A", "unknown", "medium", 50.0), ("suggestion-2", "Untitled suggestion", "unknown", "high", 10.0)]
    for bad in ("sorry", '[{"title": "A"}]', '{"suggestions": "none"}', '{"suggestions": [null]}', None):
        one = reports.suggestions(spark.createDataFrame([(bad,)], "value string")).collect()
        assert [(r.id, r.type, r.priority, r.risk_score) for r in one] == [("error-1", "analysis-error", "low", 0.0)]


def test_shown_numbers_round_the_binary_value(spark):
    from decimal import ROUND_HALF_UP, Decimal

    values = [1.005, 1.45, 0.125, 2.5, -1.005, 1234.565, 0.0, 1e-9, 123456.785] + [k / d for k in range(400) for d in (7, 8, 40, 200, 1000)]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", scores.shown(F.col("x"), 2).alias("two"), scores.shown(F.col("x"), 1).alias("one")).collect()
    for r in rows:
        assert r.two == str(Decimal(r.x).quantize(Decimal("0.01"), ROUND_HALF_UP)) and r.one == str(Decimal(r.x).quantize(Decimal("0.1"), ROUND_HALF_UP))
    assert rows[0].two == "1.00" and rows[1].one == "1.4"


def test_strong_components_and_counts(spark):
    rng = random.Random(4)
    edges = list({(rng.randrange(40), rng.randrange(40)) for _ in range(52)})
    after = {n: set() for e in edges for n in e}
    for n in after:
        pending = [n]
        while pending:
            x = pending.pop()
            for a, b in edges:
                if a == x and b not in after[n]:
                    after[n].add(b)
                    pending.append(b)
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    assert {r.node for r in graph.cycle_members(df).collect()} == {n for n in after if n in after[n]}
    assert {r.node: r.n for r in reach.sizes(df).collect()} == {n: sum(n in after[m] for m in after if m != n) for n in after}


def test_chains_name_their_symbols(spark):
    files = [("/p/a.ts", "import { f, g as h } from './b';\nimport d from './c';\n"), ("/p/b.ts", "import { k } from './c';\nexport const f = 1;\nexport const g = 2;\n"), ("/p/c.ts", "export const k = 1;\n")]
    got = tools.dependency_trace(Corpus(source.from_rows(spark, files)), "/p/a.ts", unused=False)
    assert {tuple(r.path): r.symbols for r in got["forward"].collect()} == {("/p/a.ts", "/p/b.ts"): ["f", "g"], ("/p/a.ts", "/p/c.ts"): [], ("/p/a.ts", "/p/b.ts", "/p/c.ts"): ["k"]}
    assert got["summary"].first().n_files == 3


def test_coverage_tools(spark):
    f = spark.createDataFrame([("src/a.ts", 1, 2, 50.0), ("src/b.ts", 0, 8, 0.0), ("lib/c.ts", 4, 4, 100.0)], "path string, covered int, total int, pct double")
    got = tools.coverage(f, threshold=60)
    one = got["summary"].first()
    assert one.overall == 50 and abs(one.lines - 500 / 14) < 1e-9 and one.meets is False and one.branches == one.overall
    assert [r.path for r in got["lowest"].collect()][0] == "src/b.ts" and len(got["recommendations"].first().said) == 3
    assert tools.coverage(f, "lib")["summary"].first().meets is None


def test_streaming(spark, tmp_path):
    from quillspan.streaming import reindex

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ts").write_text("import b from './b';\nif (1) {}\n")
    q = reindex.metrics(reindex.watch(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.language, r.complexity, r.dependencies) for r in spark.table("seen").collect()] == [("typescript", 1, ["./b"])]


def test_ids_follow_order(corpus):
    rows = findings.opportunities(corpus.files, corpus.symbols)
    assert rows.count() == 0 and "id" in rows.columns
    assert findings.severity_summary(rows).first().total == 0
    assert corpus.files.select(F.max("n_lines")).first()[0] > 10


def test_config(tmp_path):
    import json

    from quillspan import config

    assert config.load(str(tmp_path), {})["safety"]["max_risk_score"] == 75
    (tmp_path / "quillspan.json").write_text(json.dumps({"safety": {"max_risk_score": 20}, "exclude": ["x"]}))
    got = config.load(str(tmp_path), {"QUILLSPAN_PARALLEL": "false", "QUILLSPAN_MAX_RISK_SCORE": "30"})
    assert got["safety"] == config.DEFAULTS["safety"] | {"max_risk_score": 30} and got["exclude"] == ["x"] and not got["validation"]["parallel"]
    (tmp_path / "quillspan.json").write_text(json.dumps({"safety": {"max_risk_score": 200}, "exclude": ["x"]}))
    assert config.load(str(tmp_path), {}) == config.DEFAULTS


def test_changes_are_applied_and_put_back(spark, tmp_path):
    from quillspan import sinks

    root = tmp_path / "root"
    root.mkdir()
    (root / "a.txt").write_text("old")
    (root / "b.txt").write_text("b")
    changes = reports.changes(spark, [("a.txt", "update", "new"), ("b.txt", "delete", None), ("c/d.txt", "create", "made")])
    assert len(sinks.apply(changes, str(root), dry_run=True)) == 3 and (root / "a.txt").read_text() == "old"
    bad = sinks.execute_safely(changes, str(root), str(tmp_path / "kept"), {"test": ["false"]})
    assert bad["rolled_back"] and (root / "a.txt").read_text() == "old" and (root / "b.txt").exists() and not (root / "c/d.txt").exists()
    good = sinks.execute_safely(changes, str(root), str(tmp_path / "kept2"), {"test": ["true"]})
    assert good["passed"] and (root / "a.txt").read_text() == "new" and not (root / "b.txt").exists() and (root / "c/d.txt").read_text() == "made"
    with pytest.raises(ValueError):
        sinks.apply(reports.changes(spark, [("../x", "create", "")]), str(root))


def test_manifest_commands():
    assert reports.commands('{"scripts": {"test": "x", "coverage": "y"}}') == {"coverage": ["npm", "run", "coverage"], "test": ["npm", "run", "test"]}
    assert reports.commands("no") == {} and reports.commands("[]") == {}


def test_numbers_follow_the_order(spark):
    from quillspan.operators.ranking import numbered

    rows = [(k * 7919 % 1000,) for k in range(1000)]
    got = numbered(spark.createDataFrame(rows, "x int").repartition(5), [F.col("x")], "n").collect()
    assert {(r.x, r.n) for r in got} == {(k, k + 1) for k in range(1000)}
    assert numbered(spark.createDataFrame([], "x int"), [F.col("x")], "n").count() == 0


def test_recommendations_follow_their_conditions(spark):
    busy = [(f"/p/u{k}.ts", "import { a } from './a';\n") for k in range(11)]
    c = Corpus(source.from_rows(spark, [("/p/a.ts", "export const a = 1;\n"), ("/p/a.test.ts", "import { a } from './a';\n"), *busy]))
    one = tools.impact(c, "/p/a.ts", "a")["summary"].first()
    assert one.direct == 12 and one.coverage == 80.0 and len(one.recommendations) == 2  # many importers, and the symbol
    assert tools.impact(c, "/p/a.test.ts")["summary"].first().recommendations == ["The file has no test; add one first."]
    dead = tools.find_dead_code(c, ["/p/u0.ts"])["recommendations"].first()[0]
    assert len(dead) == 2 and dead[0].endswith("imports are not used; remove them.")
    health = tools.project_health(c).first()
    assert health.recommendations == [f"Add tests: coverage is {100 / 12:.1f}%."]
    assert len(tools.context(c)["summary"].first().recommendations) >= 1 and tools.context(c)["above"].count() == 0
