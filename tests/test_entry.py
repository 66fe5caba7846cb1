import os

import pytest

import __spark_entry__ as entry
from tessera.plans import registry

SF = "/root/testdata/sf0.001"
SAMPLE = ("exclusion_flow", "classification_metrics", "family_components", "split_score", "canonical_article_url", "tfidf", "components_chain")


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and set(registry.queries()) <= set(q) and len(registry.queries()) > 150


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_queries_match_their_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got = entry.queries()[name](spark, SF)
    want = c.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)

    def norm(v):
        return f"{v:.5f}" if isinstance(v, float) else str(v)

    assert sorted(tuple(map(norm, r)) for r in got.select(cols).collect()) == sorted(tuple(map(norm, r)) for r in want.fetchall())


def test_core_does_not_import_the_optional_subpackage():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tessera")
    for d, _, names in os.walk(root):
        if os.path.basename(d) != "llm":
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(d, n)) as f:
                        assert "tessera.llm" not in f.read(), n
