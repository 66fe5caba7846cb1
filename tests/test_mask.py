"""Masking makes each step of a text once."""

from tessera.functions import text as T


def test_masking_is_made_once(spark):
    rows = [
        ("See www.x.y/z srcA, xsrcA srcA1 SRCA Éa&amp;amp;b fake", "srcA"), ("A&amp;amp;amp;B ﬁne real", "x"), (None, None), ("aasrcA srcA srcAsrcA", "srcA"), ("é.b é.b! éé.b", "é.b"), ("plain &lt;facebook&gt;", ""),
    ]
    df = spark.createDataFrame(rows, "t string, s string").select(T.mask_artifacts("t", "s").alias("m"))
    assert [r.m for r in df.collect()] == ["See , xsrcA srcA1 Éa&b", "A&amp;B fine", "", "aasrcA srcAsrcA", "! é", "plain < >"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("https?://") == 1
