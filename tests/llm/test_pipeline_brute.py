"""The whole pipeline against plain code: DuckDB for the rules and the mixture, sets of shingles, the stated patterns, the library."""

import hashlib
import os

import pandas as pd
import public_tokenizers
import pytest
from test_groups_and_spans import alike_of
from test_secret_formats import brute
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"


def replaced(text):
    """``text`` with [SECRET] for each stretch that base spans cover."""
    covered = sorted((int(s.split(":")[1]), int(s.split(":")[2])) for s in brute(text)[4].split(",") if s)
    out, at = "", 0
    for a, z in covered:
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, z)
    return out + text[at:]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_run_against_brute_force(spark):
    from quillspan.llm.queries import oracle_sql

    sql, db = oracle_sql(), duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    good = {r[0] for r in db.sql(f"SELECT doc_id FROM ({sql['op1_quality_rules']}) WHERE posterior >= 0.5").fetchall()}
    docs = sorted((r for r in db.sql("SELECT doc_id, text, source FROM documents").fetchall() if r[0] in good), key=lambda r: r[0])
    root = alike_of([t for _, t, _ in docs])
    single = [docs[k] for k in sorted(set(root))]
    clean = [(i, replaced(t or ""), s) for i, t, s in single]
    frame = pd.DataFrame(clean, columns=["doc_id", "text", "source"])  # noqa: F841
    db.sql("CREATE OR REPLACE VIEW documents AS SELECT * FROM frame")
    copies = {i: taken // size for i, size, taken in db.sql(f"SELECT doc_id, size, taken FROM ({sql['op4_mixing']})").fetchall() if size}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t, _ in clean:
        ids = library.encode(t, add_special_tokens=False).ids
        want += [(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] * copies.get(i, 0)
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, DATA).collect()]
    assert sorted(got) == sorted(want) and len(want) > 100


def test_stages_on_odd_rows_and_none(spark):
    from cases import documents, empty

    for start in (documents, empty):
        docs = start(spark)
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, DATA)
            assert k == 4 or docs.columns == columns
        assert (docs.count() == 0) == (start is empty)
