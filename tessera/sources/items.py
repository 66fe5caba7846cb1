"""Item tables from CSV and JSON collections, their labels and sidecar counts."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import clean_text, join_text, stable_id

# The label dictionary.
LABELS = (
    ("coaid", "fake", "unreliable"),
    ("coaid", "real", "reliable"),
    ("fakehealth", "rating_0", "unreliable"),
    ("fakehealth", "rating_1", "unreliable"),
    ("fakehealth", "rating_2", "unreliable"),
    ("fakehealth", "rating_3", "reliable"),
    ("fakehealth", "rating_4", "reliable"),
    ("fakehealth", "rating_5", "reliable"),
)


def label_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELS, "dataset string, native_label string, harmonized_label string")


def label_from_name(name: Column, unreliable: str = "Fake", reliable: str = "Real") -> Column:
    """Label out of a file name; neither word is an error."""
    return F.when(name.contains(unreliable), "unreliable").when(name.contains(reliable), "reliable").otherwise(F.raise_error(F.concat(F.lit("no label in file name "), name)).cast("string"))


def label_from_rating(rating: Column) -> Column:
    """Three and more is reliable; no number gives null, which the caller reports as a parse issue."""
    r = rating.try_cast("double")
    return F.when(r >= 3, "reliable").when(r < 3, "unreliable")


def rating_label(rating: Column) -> Column:
    """rating_ and the number without trailing zeros."""
    r = rating.try_cast("double")
    return F.concat(F.lit("rating_"), F.when(r == F.floor(r), F.floor(r).cast("string")).otherwise(r.cast("string")))


def distinct_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct values by key (as text); rows without either are left out; no rows if a column is absent."""
    if key not in df.columns or value not in df.columns:
        return df.sparkSession.createDataFrame([], f"{key} string, n long")
    return df.dropna(subset=[key, value]).groupBy(F.col(key).cast("string").alias(key)).agg(F.countDistinct(value).alias("n"))


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with a header and quoted line breaks, everything as text; an unnamed first column is source_index."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    first = df.columns[0]
    return df.withColumnRenamed(first, "source_index") if first in ("_c0", "Unnamed: 0", "") else df


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of a glob, by Hadoop's file systems."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(x.getPath().toString() for x in found or ())


def first_lines(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The first line of every file that has one, in one job: a row a file reaches the driver."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i"), "value")
    rows = lines.where("at = 0").groupBy("path").agg(F.min_by("value", "i").alias("line")).collect()
    return {unquote(r["path"]): r["line"] for r in rows}


def by_header(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """Paths of files that begin with the same header; one with a line break inside its header is alone, empty ones are left out."""
    groups: dict[str, list[str]] = {}
    for path, line in sorted(first_lines(spark, paths).items()):
        groups.setdefault(line if line.count('"') % 2 == 0 else f"{line}\n{path}", []).append(path)
    return list(groups.values())


def read_csv_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files that may differ in their columns, united by name, with ``file``; files of one header are one scan."""
    groups = by_header(spark, paths) if paths else []
    if not groups:
        raise FileNotFoundError("no CSV files")
    parts = [read_csv(spark, own).withColumn("file", F.input_file_name()) for own in groups]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_csv_items(spark: SparkSession, root: str, dataset: str = "coaid") -> DataFrame:
    """Items of ``root/<date>/*.csv``; sidecars of tweets and replies give the counts.

    The folder is the collection date; unit and label come from the file name.
    """
    df = read_csv_files(spark, [p for p in list_files(spark, f"{root}/*/*.csv") if not re.search(r"_(tweets|replies)[^/]*$", p)])
    for c in ("newstitle", "title", "content", "abstract", "news_url", "news_url2", "news_url3", "news_url4", "news_url5", "publish_date"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    urls = F.filter(F.array(*[clean_text(c) for c in ("news_url2", "news_url3", "news_url4", "news_url5")]), lambda u: u != "")
    index = F.coalesce(F.col("source_index"), F.lit("")) if "source_index" in df.columns else F.lit("")
    return df.select(
        F.lit(dataset).alias("dataset"),
        stable_id(F.lit(dataset), name, index, prefix="item").alias("record_id"),
        index.alias("source_record_id"),
        name.alias("source_file"),
        F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("collection_date"),
        F.when(name.startswith("Claim"), "claim").otherwise("article").alias("text_unit"),
        label_from_name(name).alias("harmonized_label"),
        clean_text(F.coalesce("newstitle", "title")).alias("title"),
        join_text("abstract", "content").alias("body_text"),
        clean_text("news_url").alias("url"),
        F.to_json(urls).alias("alternate_urls"),
        clean_text("publish_date").alias("publish_date"),
    )


def read_json_items(spark: SparkSession, reviews: str, contents: str, engagements: str | None = None, dataset: str = "fakehealth") -> DataFrame:
    """Items of a JSON list of reviews, one JSON file per article, and a JSON map of engagement ids.

    A review whose article file is missing stays, with parse_status
    ``content_file_missing``.
    """
    r = spark.read.json(reviews, multiLine=True)
    for c in ("news_id", "rating", "title", "original_title", "source_link", "news_source"):
        if c not in r.columns:
            r = r.withColumn(c, F.lit(None).cast("string"))
    schema = "title string, text string, url string, source string, publish_date string"
    c = spark.read.schema(schema).json(contents, multiLine=True)
    c = c.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("news_id"), F.col("title").alias("c_title"), "text", "url", "source", "publish_date", F.lit(True).alias("found"))
    got = r.withColumn("news_id", F.col("news_id").cast("string")).join(c, "news_id", "left")
    status = F.when(F.col("found").isNull(), "content_file_missing").when(label_from_rating(F.col("rating")).isNull(), "rating_missing").otherwise("ok")
    got = got.select(
        F.lit(dataset).alias("dataset"),
        stable_id(F.lit(dataset), "news_id", prefix="item").alias("record_id"),
        F.col("news_id").alias("source_record_id"),
        status.alias("parse_status"),
        label_from_rating(F.col("rating")).alias("harmonized_label"),
        rating_label(F.col("rating")).alias("native_label"),
        clean_text(F.coalesce("c_title", "original_title", "title")).alias("title"),
        clean_text("text").alias("body_text"),
        clean_text(F.coalesce("source", "news_source")).alias("source_name"),
        clean_text(F.coalesce("url", "source_link")).alias("url"),
        F.lit("[]").alias("alternate_urls"),
        clean_text("publish_date").alias("publish_date"),
        F.coalesce("found", F.lit(False)).alias("content_file_available"),
    )
    if engagements is None:
        return got
    ids = spark.read.text(engagements, wholetext=True).select(F.explode(F.from_json("value", "map<string, struct<tweets: array<string>, replies: array<string>, retweets: array<string>>>")).alias("source_record_id", "e"))
    n = lambda c: F.coalesce(F.size(F.array_distinct(f"e.{c}")), F.lit(0)).cast("long")
    ids = ids.select("source_record_id", n("tweets").alias("tweet_count"), n("replies").alias("reply_count"), n("retweets").alias("retweet_count"))
    got = got.join(ids, "source_record_id", "left")
    for k in ("tweet_count", "reply_count", "retweet_count"):
        got = got.withColumn(k, F.coalesce(k, F.lit(0)))
    return got.withColumn("engagement_available", F.col("tweet_count") + F.col("reply_count") + F.col("retweet_count") > 0)
