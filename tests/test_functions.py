import posixpath
import random

from pyspark.sql import functions as F

from quillspan.functions import scores
from quillspan.functions import text as fx


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_language_and_tests(spark):
    rows = spark.createDataFrame([("/a/b.TS",), ("/a/.ts",), ("/a.ts/b",), ("x.py",), ("/a/specs/b.go",), ("",)], "p string")
    assert [r[0] for r in rows.select(fx.language(F.col("p"))).collect()] == ["typescript", "other", "other", "python", "go", "other"]
    assert [r[0] for r in rows.select(fx.is_test(F.col("p"))).collect()] == [False, False, False, False, True, False]


def test_complexity_of_files_and_functions(spark):
    code = "if (a) {\n} else if (b) {\n}\nconst notify = () => 1;\ndef \n"
    assert one(spark, fx.file_complexity(F.col("c")), c=code) == 4  # "notify" holds "if"
    assert one(spark, fx.file_complexity(F.col("c")), c="") == 0
    assert one(spark, fx.function_complexity(F.col("c")), c=code) == 1 + 2 + 1
    assert one(spark, fx.function_complexity(F.col("c")), c="éif (x) a && b || c ? d : e; case 1: catch (e) while(1)") == 1 + 1 + 2 + 1 + 1 + 1 + 1
    assert one(spark, fx.n_lines(F.col("c")), c="") == 1


def test_imports(spark):
    js = "import a from 'x';\nimport {\n b } from 'y';\nimport 'z';\nimport * as q from \"./q\";import a from 'x'"
    assert one(spark, fx.js_imports(F.col("c")), c=js) == ["x", "./q", "x"]
    assert one(spark, fx.python_imports(F.col("c")), c="import os, sys\n  from a.b import c\nx = 1\nimport d as e") == ["os", "a.b", "d"]
    assert one(spark, fx.go_imports(F.col("c")), c='import "fmt"\nimport (\n "a"\n b "c/d"\n)') == ["fmt", "a", "c/d"]


def test_paths_against_posixpath(spark):
    rng = random.Random(3)
    paths = ["/".join(rng.choice(["a", "b", "..", ".", "", "cc"]) for _ in range(rng.randint(1, 7))) for _ in range(200)]
    paths += ["/" + p for p in paths]
    df = spark.createDataFrame([(p, paths[k - 1]) for k, p in enumerate(paths)], "p string, q string")
    for p, got in df.select("p", fx.normalize(F.col("p"))).collect():
        want = posixpath.normpath(p) if p.strip("/") else ("/" if p else "")
        assert got == ("/" + want.lstrip("/") if p.startswith("/") else "" if want == "." else want), p
    pairs = [("/a/b", "/a/b/c.ts"), ("/a/b", "/a/c.ts"), ("/a/b", "/x/y.ts"), ("/", "/a")]
    for a, b, got in spark.createDataFrame(pairs, "a string, b string").select("a", "b", fx.relative_path(F.col("b"), F.col("a"))).collect():
        assert got == posixpath.relpath(b, a)


def test_scores_stay_in_range(spark):
    rng = random.Random(5)
    rows = [(rng.uniform(0, 200), rng.randint(0, 300), rng.uniform(0, 100), rng.randint(0, 99)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a double, n int, c double, k int")
    got = df.select(scores.safety(F.col("a"), F.col("n"), F.col("c")), scores.risk(F.col("n"), F.col("k"), F.col("k"), F.col("c")), scores.health(F.col("a"), F.col("c"), F.col("n"))).collect()
    assert all(0 <= x <= 100 for r in got for x in r)
    assert one(spark, scores.safety(F.lit(0.0), F.lit(0))) == 70
    assert one(spark, scores.percentage(F.lit(0), F.lit(0))) == 0
    assert one(spark, scores.risk(F.lit(1), F.lit(2), F.lit(3), F.lit(80.0))) == 21


def test_references_and_free_names(spark):
    assert one(spark, fx.type_references(F.col("c")), c="Foo Bar_1 fooBar Foo éFoo x.Baz") == ["Foo", "Bar_1", "Baz"]
    assert one(spark, fx.trim(F.col("c")), c="\xa0\t x \n﻿") == "x"
