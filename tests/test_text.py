import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T


def one(spark, values, f, schema="i int, x string"):
    df = spark.createDataFrame(list(enumerate(values)), schema)
    return [r[1] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean_text(spark):
    got = one(spark, [None, " a\t b\n", "NaN", "n/a", " None ", "x&amp;amp;y", "ﬁ​ne", "\x00a\x00", "a\xa0b", "é"], T.clean_text)
    assert got == ["", "a b", "", "", "", "x&amp;y", "fine", "a", "a b", "é"]


def test_join_text_cleans_at_every_level(spark):
    df = spark.createDataFrame([("a &amp;amp; b", None, " c ")], "x string, y string, z string")
    assert df.select(T.join_text("x", "y", "z")).first()[0] == "a & b c"


@pytest.mark.parametrize(
    ("raw", "want"),
    [("AP Associated Press", "ap"), ("http://abcnews.go.com", "abcnews"), ("HTTP News", "http news"), ("The Reuters Health", "reuters"), ("Acme, Inc.", "acme"), ("https://web.archive.org", ""), ("www.cnn.com", "cnn")],
)
def test_publisher_names(spark, raw, want):
    assert one(spark, [raw], T.normalize_publisher_name) == [want]


def test_domains(spark):
    urls = ["http://www.example.com", "https://web.archive.org/web/2020/http://news.site.co.uk/a", "sub.a.example.org/x", "http://archive.org/x", "http://host:80/a", None, "localhost"]
    assert one(spark, urls, T.registrable_domain) == ["example.com", "site.co.uk", "example.org", "", "host", "", "localhost"]
    assert one(spark, ["http://WWW.A.com:80/x", "a.b/c"], T.domain_from_url) == ["a.com:80", "a.b"]


def test_canonical_urls(spark):
    urls = [
        "http://www.example.com//a/b/?utm_source=x&id=2&b=1&fbclid=z#top", "https://web.archive.org/web/2019/http://www.example.com/a/", "example.com/x?b=%20y&a=1", "http://example.com", "", "http://e.com/p?flag&x=1", "http://e.com/p?ref=a",
    ]
    assert one(spark, urls, T.canonical_article_url) == ["https://example.com/a/b?b=1&id=2", "https://example.com/a", "https://example.com/x?a=1&b=+y", "", "", "https://e.com/p?flag=&x=1", "https://e.com/p"]


def test_page_reasons(spark):
    texts = ["Access denied for this request today", "403 Forbidden - nginx server here", "You must log in to continue please", "JavaScript is disabled in your browser now", "  Facebook  ", "ok", "word " * 300 + " access denied"]
    assert one(spark, texts, T.content_exclusion_reason) == ["access_denied_page", "forbidden_page", "login_or_signup_page", "javascript_disabled_page", "near_empty_text", "near_empty_text", ""]
    assert one(spark, ["*** Instagram *** "], T.content_exclusion_reason) == ["near_empty_text"]


def test_mask(spark):
    df = spark.createDataFrame([("See https://x.y/z The Daily.Star says FAKE facebook press release daily realism", "Daily.Star")], "t string, s string")
    got = df.select(T.mask_artifacts("t", "s")).first()[0]
    assert got == "See The says realism"


def test_counts(spark):
    assert one(spark, ["Fake and REAL, realism", None], T.count_terms) == [2, 0]
    assert one(spark, ["the URL", "curl"], T.is_artifact_feature) == [True, False]
    assert one(spark, ["don't re-do Éa 1", ""], T.word_count_unicode) == [4, 0]
    assert one(spark, ["a Éa bb c1 _x", ""], T.token_count) == [4, 0]
    assert one(spark, ["abé", "", "12"], T.latin_fraction) == [pytest.approx(2 / 3), 0.0, 0.0]


def test_dates(spark):
    got = one(spark, ["15-May", "2020-05-15", "1589500800", "1589500800000", "May 15, 2020 at 1:05 PM PDT", "", None, "0001-01-01"], T.normalize_date)
    assert got == ["", "2020-05-15T00:00:00Z", "2020-05-15T00:00:00Z", "2020-05-15T00:00:00Z", "2020-05-15T20:05:00Z", "", "", ""]


def test_alternate_urls(spark):
    assert one(spark, ['["a", "b", ""]', "a| b|", '"c"', "[]", None], T.parse_alternate_urls) == [["a", "b"], ["a", " b"], ["c"], [], []]


def test_publisher_ids(spark):
    df = spark.createDataFrame(
        [("d", "Health Day", "http://a.x.com/1", False), ("d", "HealthDay", "http://b.y.com/1", False), ("d", "Reuters Health", "http://a.x.com/2", False), ("c", "n1", "http://a.z.com/1", True), ("c", "n2", "http://b.z.com/1", True), ("d", "", "", False)],
        "dataset string, source_name string, url string, url_named boolean",
    )
    p = [r.publisher_id for r in T.assign_publisher_ids(df).collect()]
    assert p[0] == p[1] != p[2] and p[3] == p[4] and p[5] == ""
