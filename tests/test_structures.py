"""Reach sizes, cycles, upkeep, postings, nesting, intervals, nearest definitions and names against plain code."""

import random
import re
import time
from collections import deque
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from quillspan.functions import text as fx
from quillspan.operators import coverage, findings, graph, intervals, names, nearest, nesting, postings, reach
from quillspan.plans import samples, tools
from quillspan.plans.corpus import Corpus, invalidate, open_corpus
from quillspan.sources import corpus as source
from quillspan.storage import durable


def frame(spark, edges):
    return spark.createDataFrame(sorted(edges), "src bigint, dst bigint")


def depths(edges, seeds):
    found, pending = dict.fromkeys(seeds, 0), deque(seeds)
    while pending:
        a = pending.popleft()
        for x, b in edges:
            if x == a and b not in found:
                found[b] = found[a] + 1
                pending.append(b)
    return found


def random_edges(seed, n=40, m=60):
    rng = random.Random(seed)
    return {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}


def test_sizes_in_many_blocks_and_estimates(spark):
    edges = random_edges(1, 150, 170) | {(200 + k, 201 + k) for k in range(6)} | {(5, 5)}
    nodes = {n for e in edges for n in e}
    after = {n: set(depths(edges, [n])) for n in nodes}
    true = {n: sum(n in after[m] for m in nodes if m != n) for n in nodes}
    assert {r.node: r.n for r in reach.sizes(frame(spark, edges), words=1, together=2).collect()} == true
    few = {r.node: r.n for r in reach.estimated_sizes(frame(spark, edges), 16).collect()}
    wrong = [abs(few[n] - true[n]) / true[n] for n in nodes if true[n] >= 20]
    assert all(few[n] == true[n] for n in nodes if true[n] < 15) and sum(wrong) / max(len(wrong), 1) < 0.35
    assert reach.sizes(frame(spark, {(1, 1)})).collect()[0].n == 0


def test_one_shortest_cycle_an_edge(spark):
    edges = random_edges(2, 30, 60) | {(50 + k, 50 + (k + 1) % 7) for k in range(7)} | {(9, 9), (60, 61)}
    after = {n: depths(edges, [n]) for e in edges for n in e}
    got = reach.shortest_cycles(frame(spark, edges)).collect()
    assert len({(r.src, r.dst) for r in got}) == len(got) <= len(edges)
    for r in got:
        assert r.files[0] == r.files[-1] == r.dst and r.files[-2] == r.src and all(e in edges for e in zip(r.files, r.files[1:], strict=False))
        assert len(r.files) == len(set(r.files)) + 1 and len(r.files) - 2 == after[r.dst][r.src]
        assert r.severity == ("high" if len(r.files) > 4 else "medium")
    component = lambda n: frozenset(m for m in after if m in after[n] and n in after[m])
    on_cycle = {component(n) for n in after if len(component(n)) > 1}
    assert {component(r.src) for r in got if r.src != r.dst} == on_cycle and any(len(r.files) == 8 for r in got)


def test_refreshed_equals_recomputed(spark):
    rng, edges = random.Random(3), random_edges(3, 50, 110)
    known = graph.reachable(frame(spark, edges), spark.createDataFrame([(0,), (1,)], "node bigint"))
    gone = set(rng.sample(sorted(edges), 25)) | {(99, 98)}
    added = {(rng.randrange(60), rng.randrange(60)) for _ in range(8)} | {(2, 70), (70, 71)}
    seeds = spark.createDataFrame([(1,), (2,)], "node bigint")
    got = reach.refreshed(known, frame(spark, edges), frame(spark, gone), frame(spark, added), seeds)
    assert sorted((r.node, r.depth) for r in got.collect()) == sorted(depths((edges - gone) | added, [1, 2]).items())


def test_refreshed_without_a_change(spark):
    edges = random_edges(7)
    seeds, none = spark.createDataFrame([(0,)], "node bigint"), spark.createDataFrame([], "src bigint, dst bigint")
    known = graph.reachable(frame(spark, edges), seeds)
    assert sorted(map(tuple, reach.refreshed(known, frame(spark, edges), none, none, seeds).collect())) == sorted(depths(edges, [0]).items())


def test_postings_equal_a_scan_and_read_few_buckets(spark, tmp_path):
    texts = {1: "a b a $x b2 a", 2: None, 3: "", 4: "été b", 5: "a " * 500, 6: "2a _b"}
    docs = spark.createDataFrame(list(texts.items()), "id bigint, body string")
    index = postings.Postings.build(postings.postings(docs, "id", "body"), str(tmp_path / "index"), buckets=16)
    want = {}
    for k, t in texts.items():
        for at, w in enumerate(re.findall(r"[^\W\d]\w*|\$\w*", (t or "").replace("$x", "$x"))):
            want.setdefault((w, k), []).append(at)
    assert {(r.token, r.key): r.positions for r in index.table().collect()} == want
    found = index.lookup("a", "été", "nowhere")
    assert {(r.token, r.key): r.positions for r in found.collect()} == {x: p for x, p in want.items() if x[0] in ("a", "été")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(token" in plan
    assert len(found.inputFiles()) >= len(found.select("token").distinct().collect())
    buckets = {index.bucket(t) for t in ("a", "été", "nowhere")}
    assert {int(re.search(r"bucket=(\d+)", r.f)[1]) for r in found.select(F.input_file_name().alias("f")).collect()} <= buckets
    asked = spark.createDataFrame([("b",), ("b",), ("zz",)], "token string")
    assert {(r.token, r.key) for r in index.having(asked).collect()} == {x for x in want if x[0] == "b"}
    assert {(r.key, r.n) for r in index.counts("a").collect()} == {(1, 3), (5, 500), (6, 1)}


def slow_tree(text):
    """Elements by looking for each one's end from its start: quadratic, without a stack of nodes."""
    marks = [(m.start(), m.end(), m[0]) for m in re.finditer(r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|</?[a-z][a-z0-9]*\b[^>]*>|<![^>]*>", text)]
    tags = [(a, z, re.match(r"</?([a-zA-Z][a-zA-Z0-9]*)", s)[1].lower(), s) for a, z, s in marks if not s.startswith("<!")]
    leaf = lambda tag, s: tag in (*nesting.VOID, "script", "style") or s.endswith("/>")
    out = []
    for k, (a, z, tag, s) in enumerate(tags):
        if s.startswith("</") and tag not in ("script", "style"):
            continue
        end = z if leaf(tag, s) else None
        around = []  # tags open around this element, from replaying what is before it
        for _, _, t, x in tags[:k]:
            if x.startswith("</") and t not in ("script", "style"):
                if t in around:
                    del around[len(around) - 1 - around[::-1].index(t) :]
            elif not leaf(t, x):
                around.append(t)
        inner = []
        for b, y, t, x in tags[k + 1 :] if end is None else ():
            if x.startswith("</") and t not in ("script", "style"):
                if t in inner:
                    del inner[len(inner) - 1 - inner[::-1].index(t) :]
                elif t == tag:
                    end = y
                elif t in around:
                    end = b
            elif not leaf(t, x):
                inner.append(t)
            if end is not None:
                break
        out.append((tag, a, len(text) if end is None else end))
    return out


def test_elements_of_odd_markup(spark):
    rng = random.Random(3)
    texts = ["", "no tags < here >", "<p>a<p>b", "<div><b>x</div></b>", "<a><b></a></b><c>", "<br><img/><p/>x</p>", "<script>if (a<b) '</p>'</script><style>p{}</style>", "<!-- <p> --><!DOCTYPE html><P>x</p >"]
    texts += ["".join(rng.choice(["<a>", "</a>", "<b x='1'>", "</b>", "<br>", "t", "<c>", "</c>", "<!-- <a> -->"]) for _ in range(40)) for _ in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), (None, None)], "id bigint, html string")
    rows = nesting.elements(docs, "id", "html").collect()
    for k, t in enumerate(texts):
        own = sorted((r for r in rows if r.id == k), key=lambda r: r.node)
        assert [(r.tag, r.start, r.end) for r in own] == slow_tree(t), t
        for r in own:
            holds = [x for x in own if x.node != r.node and x.start <= r.start and r.end <= x.end and (x.start, -x.end) < (r.start, -r.end)]
            assert r.parent == max((x.node for x in holds), default=None)
    got = {(r.id, r.node) for r in nesting.maximal(nesting.elements(docs, "id", "html"), F.lit(10), F.lit(120)).collect()}
    inside = {(r.id, r.node): r for r in rows if r.start >= 10 and r.end <= 120}
    assert got == {x for x, r in inside.items() if (r.id, r.parent) not in inside}


def test_depth_across_chunks_and_rows(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("<<>>ab\n") for _ in range(997))
    docs = spark.createDataFrame([(1, 0, text), (2, 0, ""), (3, 0, None), (4, 0, "<<"), (4, 1, ">a<"), (4, 2, ">>")], "id bigint, seq int, body string")
    want, depth = [], 0
    for ch in text:
        depth += (ch == "<") - (ch == ">")
        want += [depth] if ch in "<>" else []
    for chunk in (1, 7, 100, 5000):
        rows = nesting.depths(docs, "id", "body", chunk=chunk, order="seq").orderBy("id", "piece", "chunk", "at").collect()
        assert [r.depth for r in rows if r.id == 1] == want
        assert [r.depth for r in rows if r.id == 4] == [1, 2, 1, 2, 1, 0] and {r.id for r in rows} == {1, 4}


def test_pairs_are_made_once_and_with_nulls(spark, monkeypatch):
    """Rounds of a closure write rows of nodes and blocks, not pairs; a null is an end like any other, and leads nowhere."""
    written, write = [], graph.durable
    monkeypatch.setattr(graph, "durable", lambda df, tag: written.append(write(df, tag)) or written[-1])
    ring = {(k, (k + 1) % 60) for k in range(60)} | {(k, (k + 7) % 60) for k in range(60)}
    found = [tuple(r) for r in graph.closure(frame(spark, ring)).collect()]
    assert sorted(found) == [(a, b) for a in range(60) for b in range(60)]
    assert max(df.count() for df in written) <= len(ring)
    odd = [(0, 1), (1, None), (None, 1), (2, 2), (3, 2)]
    want = {(0, 1), (0, None), (1, None), (None, 1), (None, None), (2, 2), (3, 2)}
    for words, together in ((4, 1024), (1, 1)):
        assert sorted(map(str, reach.pairs(spark.createDataFrame(odd, "src bigint, dst bigint"), None, words, together).collect())) == sorted(f"Row(a={a}, b={b})" for a, b in want)
    line = frame(spark, {(k, k + 1) for k in range(90)})
    for most in (1, 3, 6):
        assert {tuple(r) for r in reach.pairs(line, most, words=1, together=1).collect()} == {(a, b) for a in range(91) for b in range(a + 1, min(a + most, 90) + 1)}


def test_intervals_of_any_length(spark):
    rng = random.Random(6)
    spans = [(k % 3, k, a, a + int(2 ** rng.uniform(0, 16)) - 1) for k in range(120) for a in [rng.randrange(-5000, 60000)]]
    spans += [(0, 900, -(10**15), 10**15), (1, 901, 5, 4), (2, 902, None, 7), (0, 903, 7, 7), (0, 904, 7, 7)]
    df = spark.createDataFrame(spans, "g int, i int, start bigint, end bigint")
    good = [s for s in spans if s[2] is not None and s[2] <= s[3]]
    pairs = sorted((a[1], b[1]) for a in good for b in good if a[0] == b[0] and a[2] <= b[2] and b[3] <= a[3])
    for bits in (1, 4):
        assert sorted((r.outer.i, r.inner.i) for r in intervals.contained(df, df, ["g"], bits=bits).collect()) == pairs
    points = spark.createDataFrame([(s[0], s[2]) for s in spans], "g int, at bigint")
    counts = {r.i: r.n for r in intervals.points_inside(df, points, ["g"]).collect()}
    assert counts == {s[1]: sum(p[0] == s[0] and p[2] is not None and s[2] is not None and s[2] <= p[2] <= s[3] for p in spans) for s in spans}


def test_blocks_of_intervals_are_never_broadcast(spark):
    """A small table of long intervals has many blocks, and whoever builds a broadcast holds them all."""
    spans = durable(spark.range(50).selectExpr("id % 3 AS g", "id AS start", "id + 1000000000000 AS end"), "spans")
    pairs = intervals.contained(spans, spans, ["g"])
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == 50


def test_long_intervals_have_few_blocks(spark):
    rows = spark.createDataFrame([(0, 10**9), (1, 10**9 - 2), (123456, 123456), (-77, 5)], "a bigint, z bigint")
    for a, z, found in rows.select("a", "z", intervals.blocks(F.col("a"), F.col("z"), 8).alias("b")).collect():
        spans = sorted((b.block << 4 * b.level, (b.block + 1 << 4 * b.level) - 1) for b in found)
        assert spans[0][0] == a and spans[-1][1] == z and all(x[1] + 1 == y[0] for x, y in zip(spans, spans[1:], strict=False)) and len(spans) <= 240


def test_nearest_definitions_with_ties(spark):
    rng = random.Random(8)
    folder = lambda n: "/" + "/".join(rng.choice("abc") for _ in range(rng.randrange(0, n)))
    known = [(rng.choice("xy"), folder(5).rstrip("/") + f"/f{k % 7}.ts", k // 3) for k in range(60)] + [("x", "plain.ts", 5)]
    asked = [(k, rng.choice("xyz"), folder(5).rstrip("/") or "/r") for k in range(50)]
    definitions, references = spark.createDataFrame(known, "name string, file string, ord int"), spark.createDataFrame(asked, "id int, name string, folder string")
    pairs = references.join(definitions, "name").withColumn("d", fx.proximity(F.col("folder"), F.col("file")))
    want = {r.id: (r.best.d, r.best.file) for r in pairs.groupBy("id").agg(F.min(F.struct("d", "ord", "file")).alias("best")).collect()}
    assert {r.id: (r.distance, r.file) for r in nearest.nearest(references, definitions).collect()} == want
    assert len(want) < 50


def test_names_in_shards(spark):
    words = ["cat", "cats", "at", "New York", "x_y", "é", ""]
    texts = {1: "cats cat scat at New Yorker New York x_y x_yz é", 2: None, 3: "", 4: "catcat"}
    docs = spark.createDataFrame(list(texts.items()), "id bigint, body string")
    wanted = spark.createDataFrame([(w,) for w in [*words, "cat", None]], "name string")
    inside = {(k, w): len(re.findall(f"(?={re.escape(w)})", t)) for k, t in texts.items() if t for w in words if w and w in t}
    for most in (4_000_000, 6):
        assert {(r.id, r.name): r.n for r in names.found(docs, wanted, "id", "body", whole=False, most=most).collect()} == inside
    whole = {(r.id, r.name): (r.n, r.first) for r in names.found(docs, wanted, "id", "body").collect()}
    assert whole == {(1, "cat"): (1, 5), (1, "cats"): (1, 0), (1, "at"): (1, 14), (1, "New York"): (1, 28), (1, "x_y"): (1, 37), (1, "é"): (1, 46)}
    assert names.found(docs, wanted.limit(0), "id", "body").count() == 0


def test_a_refreshed_corpus_equals_a_new_one(spark):
    files = dict(samples.FILES)
    before = Corpus(source.from_rows(spark, sorted(files.items()), samples.ROOT), "corrected")
    seeds = ["/app/src/main.ts"]
    assert before.reached(seeds).count() > 1 and before.reached(seeds) is before.reached(seeds)
    target = "/app/src/util/format.ts"
    changed = {target: "import { late } from './late';\nexport const fmt = late;\n", "/app/src/util/late.ts": "export const late = 1;\n"}
    gone = next(p for p in sorted(files) if p.endswith(".ts") and p not in (target, *seeds))
    after = before.refreshed(source.from_rows(spark, sorted(changed.items()), samples.ROOT), [gone])
    whole = Corpus(source.from_rows(spark, sorted(({p: c for p, c in files.items() if p != gone} | changed).items()), samples.ROOT), "corrected")
    rows = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    assert rows(after.files, "path", "content", "n_lines") == rows(whole.files, "path", "content", "n_lines")
    assert rows(after.symbols, *whole.symbols.columns) == rows(whole.symbols, *whole.symbols.columns)
    assert rows(after.edges(), "src", "dst") == rows(whole.edges(), "src", "dst")
    assert rows(after.reached(seeds), "node", "depth") == rows(graph.reachable(whole.edges(), spark.createDataFrame([(s,) for s in seeds], "node string")), "node", "depth")


def test_rename_by_the_index_equals_a_scan(spark):
    corpus = Corpus(source.from_rows(spark, samples.FILES, samples.ROOT))
    path, rows = "/app/src/util/format.ts", lambda df: sorted(map(tuple, df.collect()))
    assert rows(tools.rename(corpus, path, "fmt", "show", indexed=True)["references"]) == rows(tools.rename(corpus, path, "fmt", "show")["references"]) != []
    named = {r.path for r in corpus.naming("fmt").collect()}
    assert named == {r.path for r in findings.reference_counts(corpus.files, "fmt").collect()}


def test_callers_wait_for_one_scan(spark, tmp_path, monkeypatch):
    (tmp_path / "a.ts").write_text("export const a = 1;")
    scans, scan = [], source.scan

    def slow(*args, **options):
        scans.append(1)
        time.sleep(0.5)
        return scan(*args, **options)

    monkeypatch.setattr(source, "scan", slow)
    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(lambda _: open_corpus(spark, str(tmp_path)), range(4)))
    assert len(scans) == 1 and all(c is found[0] for c in found)
    assert invalidate(str(tmp_path)) == 1 and invalidate(str(tmp_path)) == 0


def test_recommendations_name_three(spark):
    files = spark.createDataFrame([(f"f{k:02}", float(k * 10)) for k in range(9)] + [("a0", 0.0), ("a1", 0.0), ("a2", 0.0)], "path string, pct double")
    said = coverage.recommendations(files, 80.0).first().said
    assert said[1:] == ["8 files are covered by less than half, such as a0, a1, a2", "4 files are not covered, such as a0, a1, a2"] and "threshold of 80.0%" in said[0]
    assert len(coverage.recommendations(files.limit(0)).first().said) == 1
