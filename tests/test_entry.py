import glob
import importlib.util
import math
import os

import pytest

DATA = "/root/testdata/sf0.001"


def rows_of(df):
    def text(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) == "<NA>":
            return "null"
        x = x.item() if hasattr(x, "item") else x
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    columns = sorted(df.columns)
    return columns, sorted(tuple(map(text, r)) for r in df[columns].itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from quillspan.plans import registry

    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    sql = registry.oracle_sql()
    slow = {"closure", "cycle_members", "risk_score", "unreachable", "reachable", "transitive_dependents", "reach_estimates", "shortest_cycles", "refreshed_reach"}
    for name, query in registry.queries().items():
        if name in sql and name not in slow:
            assert rows_of(query(spark, DATA).toPandas()) == rows_of(db.sql(sql[name]).df()), name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())
    have = importlib.util.find_spec("quillspan.llm") is not None and importlib.util.find_spec("quillspan.llm.queries") is not None
    assert ("op1_quality_rules" in e.queries()) == have
