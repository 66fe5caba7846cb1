"""Streaming forms: engagement by day, first copies only, prediction counts.

Each takes an unbounded DataFrame and returns one; the caller attaches the
sink. State is bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def engagement_by_day(events: DataFrame, ts: str = "ts", late: str = "2 days") -> DataFrame:
    """Counts of click, view and purchase by user and day; a day closes once the watermark has passed it."""
    t = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    got = t.groupBy("user_id", F.window("_t", "1 day").alias("w")).agg(n("click").alias("tweet_count"), n("view").alias("reply_count"), n("purchase").alias("retweet_count"))
    return got.select("user_id", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "tweet_count", "reply_count", "retweet_count")


def first_copies(docs: DataFrame, text: str, ts: str, late: str = "7 days") -> DataFrame:
    """The first arrival of every normalised text inside the watermark."""
    from tessera.functions.text import normalized_text_hash

    return docs.withColumn("duplicate_group", normalized_text_hash(text)).withWatermark(ts, late).dropDuplicatesWithinWatermark(["duplicate_group"])


def outcome_counts(preds: DataFrame, ts: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """tp, fp, fn, tn by window, from which all metrics follow."""
    from tessera.operators.evaluation import counts

    return preds.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w")).agg(*counts()).select("w.start", "n", "tp", "fp", "fn", "tn")
