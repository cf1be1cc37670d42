import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_stages_do_what_they_say(spark):
    from quillspan.llm import mixing, quality_rules, simhash

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, inputs = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        inputs.append(stage(spark, inputs[-1], DATA).cache())
        assert inputs[-1].columns == columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    ruled, single, clean, mixed = inputs[1:]
    assert ids(ruled) == ids(quality_rules.score(docs).filter("posterior >= 0.5"))
    groups = simhash.similar(ruled).collect()
    assert ids(single) == sorted({r.component_id for r in groups})
    assert ids(clean) == ids(single) and all("token = \"" not in r.text for r in clean.collect())
    assert ids(mixed) == sorted(i for r in mixing.plan(clean).collect() for i in [r.doc_id] * r.copies)
    last = corpus_pipeline.STAGES[-1][1](spark, mixed, DATA)
    assert ids(last) == ids(mixed) and all(r.n_tokens == len(r.ids) for r in last.collect())
    run = corpus_pipeline.run(spark, DATA)
    assert sorted((r.doc_id, r.ids_sha256) for r in run.collect()) == sorted((r.doc_id, r.ids_sha256) for r in last.collect())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_every_query_runs(spark):
    from quillspan.llm.queries import oracle_sql, queries

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    n = docs.count()
    rows = {"op12_vector_codes": spark.read.parquet(f"{DATA}/embeddings.parquet").count(), "op13_filter_audit": 600 * docs.select("lang").distinct().count()}
    for name, query in queries().items():
        assert query(spark, DATA).count() == rows.get(name, n), name
    assert set(oracle_sql()) <= set(queries())


def test_sql_needs_no_session():
    """The driver may ask for the SQL before any session is there."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr[-500:]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["op11_setsketch", "op12_vector_codes", "op13_filter_audit"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from quillspan.llm.queries import oracle_sql, queries

    db = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got = queries()[name](spark, DATA)
    want = db.sql(oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, got.select(*want.columns).toPandas().itertuples(index=False, name=None))) == sorted(map(str, want.df().itertuples(index=False, name=None)))


def test_the_secrets_stage_learns_from_every_text(spark, monkeypatch):
    """Each of 2500 texts has a run of its own and one that all have; none is left out of the background."""
    from quillspan.llm import secret_scan

    learned, learn = [], secret_scan.learn
    monkeypatch.setattr(secret_scan, "learn", lambda *args, **options: learned.append(learn(*args, **options)) or learned[-1])
    docs = spark.createDataFrame([(k, f"riverstones and {'abcdefgh'[k % 8]}walkinghouse{'abcdefgh'[k // 8 % 8]}light no {k}") for k in range(2500)], "doc_id bigint, text string").repartition(3)
    assert corpus_pipeline.secrets_stage(spark, docs, "").count() == 2500
    pairs = learned[0].background.pairs
    assert pairs["v", "e"] == 2500 and pairs["w", "a"] == 2500
