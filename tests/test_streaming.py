from pyspark.sql import functions as F

from tessera.streaming import live


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_engagement_by_day(spark, tmp_path):
    rows = [(1, "click", "2024-01-01 01:00:00"), (1, "view", "2024-01-01 02:00:00"), (1, "click", "2024-01-02 01:00:00"), (2, "purchase", "2024-01-01 05:00:00")]
    spark.createDataFrame(rows, "user_id long, event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "e"))
    src = spark.readStream.schema("user_id long, event_type string, ts timestamp").parquet(str(tmp_path / "e"))
    got = {(r.user_id, r.day): (r.tweet_count, r.reply_count, r.retweet_count) for r in run(spark, live.engagement_by_day(src), "eng", "update")}
    assert got == {(1, "2024-01-01"): (1, 1, 0), (1, "2024-01-02"): (1, 0, 0), (2, "2024-01-01"): (0, 0, 1)}


def test_first_copies(spark, tmp_path):
    rows = [("Hello  World", "2024-01-01 01:00:00"), ("hello world!", "2024-01-01 02:00:00"), ("other", "2024-01-01 03:00:00")]
    spark.createDataFrame(rows, "t string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "d"))
    src = spark.readStream.schema("t string, ts timestamp").parquet(str(tmp_path / "d"))
    assert len(run(spark, live.first_copies(src, "t", "ts"), "cop", "append")) == 2


def test_outcome_counts(spark, tmp_path):
    rows = [(1, 1, "2024-01-01 01:10:00"), (0, 1, "2024-01-01 01:20:00"), (1, 0, "2024-01-01 02:20:00")]
    spark.createDataFrame(rows, "y int, p int, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "p"))
    src = spark.readStream.schema("y int, p int, ts timestamp").parquet(str(tmp_path / "p"))
    got = sorted((r.n, r.tp, r.fp, r.fn) for r in run(spark, live.outcome_counts(src, "ts"), "oc", "update"))
    assert got == [(1, 0, 0, 1), (2, 1, 1, 0)]
