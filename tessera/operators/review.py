"""Human review: topic tables, rosters, sheets and the gates that finish them.

Sheets are text tables; nothing fills a human column. A finisher returns the
issues it found, and results only where there is none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalized_enum, seeded_hash
from tessera.operators.relational import key_difference, rank_within, require_columns

AWAITING, COMPLETED = "awaiting_human_validation", "completed"


def candidate_topics(assignments: DataFrame, least: int = 30) -> DataFrame:
    """Topics (outliers aside) with their size, mean probability and whether they are large enough."""
    n = F.countDistinct("record_id")
    return assignments.where("topic_id <> -1").groupBy("dataset", "topic_id").agg(n.alias("records"), F.round(F.avg("assigned_probability"), 5).alias("mean_probability"), (n >= least).alias("eligible"))


def assigned_probability(topic: Column, probs: Column) -> Column:
    """Probability of the assigned topic; an outlier has 1 less the greatest, a topic out of range the greatest."""
    top = F.array_max(probs)
    return F.when(topic == -1, 1 - top).when((topic >= 0) & (topic < F.size(probs)), F.get(probs, topic)).otherwise(top)


def prevalence(narratives: DataFrame, roster: DataFrame) -> DataFrame:
    n = roster.groupBy("dataset").agg(F.countDistinct("record_id").alias("total"))
    g = narratives.groupBy("dataset", "narrative_id").agg(F.countDistinct("record_id").alias("records"))
    return g.join(F.broadcast(n), "dataset").select("dataset", "narrative_id", "records", F.round(F.col("records") / F.col("total"), 6).alias("prevalence"))


def metadata_profile(df: DataFrame, keys: list[str], columns: list[str], least: int = 30) -> DataFrame:
    """Mean, median and deviation of every column by key, null for fewer than ``least`` values."""
    long = df.unpivot(keys, columns, "field", "x")
    enough = F.count("x") >= least
    return long.groupBy(*keys, "field").agg(F.count("x").alias("n"), F.when(enough, F.round(F.avg("x"), 6)).alias("mean"), F.when(enough, F.round(F.percentile("x", 0.5), 6)).alias("median"), F.when(enough, F.round(F.stddev_samp("x"), 6)).alias("sd"))


def narrative_performance(df: DataFrame, keys: list[str], least: int = 20, per_class: int = 5) -> DataFrame:
    """Metrics by narrative, null where records or a class are too few."""
    from tessera.operators.evaluation import counts, from_counts

    g = df.groupBy(*keys).agg(*counts())
    ok = (F.col("n") >= least) & (F.col("tp") + F.col("fn") >= per_class) & (F.col("tn") + F.col("fp") >= per_class)
    m = from_counts()
    return g.select(*keys, "n", ok.alias("eligible"), *[F.when(ok, F.round(m[k], 6)).alias(k) for k in ("macro_f1", "unreliable_f1")])


def code_summary(df: DataFrame, fields: list[str]) -> DataFrame:
    long = df.select(*[F.col(c).cast("string").alias(c) for c in fields]).unpivot([], fields, "field", "value")
    g = long.groupBy("field", "value").agg(F.count("*").alias("n"))
    return g.withColumn("fraction", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("field")), 6))


def topic_review_sheet(topics: DataFrame, blanks: list[str]) -> DataFrame:
    return topics.where("eligible").select("*", *[F.lit("").alias(c) for c in blanks])


def representative_sheet(assignments: DataFrame, topics: DataFrame, docs: DataFrame, k: int = 10, chars: int = 800, blanks: list[str] = ()) -> DataFrame:
    """The k most probable records of every eligible topic with an excerpt and blank columns."""
    own = assignments.join(topics.where("eligible").select("dataset", "topic_id"), ["dataset", "topic_id"], "left_semi")
    top = rank_within(own, ["dataset", "topic_id"], [F.desc("assigned_probability"), "record_id"], "representative_rank").where(F.col("representative_rank") <= k)
    text = docs.groupBy("record_id").agg(F.min("text").alias("text"))
    return top.join(text, "record_id", "left").select("dataset", "topic_id", "record_id", "representative_rank", F.substring("text", 1, chars).alias("excerpt"), *[F.lit("").alias(c) for c in blanks])


def sample_roster(candidates: DataFrame, quotas: list[tuple[str, int]], seed: int = 613) -> tuple[DataFrame, DataFrame]:
    """(roster, shortfalls): records by stratum in order, each record once overall.

    ``candidates`` has stratum, record_id, sampling_priority, balance_group.
    Inside a stratum, groups take turns: rank in the group first, then hashed
    group, priority and hash. Every stratum sees at most its quota plus what
    earlier strata took, so only bounded rows are held.
    """
    require_columns(candidates, {"stratum", "record_id", "sampling_priority", "balance_group"}, "candidates")
    spark = candidates.sparkSession
    taken: DataFrame | None = None
    parts, short = [], []
    for i, (name, quota) in enumerate(quotas):
        own = candidates.where(F.col("stratum") == name)
        own = own.withColumn("h", seeded_hash(seed, F.lit(name), F.col("record_id").cast("string")))
        own = own.withColumn("rn", F.row_number().over(Window.partitionBy("record_id").orderBy("sampling_priority", "h"))).where("rn = 1").drop("rn")
        if taken is not None:
            own = own.join(F.broadcast(taken), "record_id", "left_anti")  # at most the quotas so far
        own = rank_within(own, ["balance_group"], ["sampling_priority", "h"], "turn", zero=True)
        own = own.withColumn("gh", seeded_hash(seed, F.lit(name), F.col("balance_group").cast("string")))
        got = own.orderBy("turn", "gh", "sampling_priority", "h", "record_id").limit(quota).select("record_id").collect()
        rows = [(i, name, k + 1, r["record_id"]) for k, r in enumerate(got)]
        kind = dict(candidates.dtypes)["record_id"]
        part = spark.createDataFrame(rows, f"stratum_index int, stratum string, place int, record_id {kind}")
        parts.append(part)
        ids = part.select("record_id")
        taken = ids if taken is None else taken.union(ids)
        short.append((name, quota, len(rows), quota - len(rows), "available" if len(rows) == quota else "unavailable"))
    roster = reduce(DataFrame.unionByName, parts)
    roster = roster.withColumn("selection_order", F.row_number().over(Window.orderBy("stratum_index", "place")))
    return roster.drop("stratum_index", "place"), spark.createDataFrame(short, "stratum string, quota int, selected int, shortfall int, status string")


def sheet_issues(sheet: DataFrame, template: DataFrame, key: list[str], context: list[str], vocabulary: dict[str, tuple[str, ...]], label: str) -> DataFrame:
    """(gate, detail) rows: wrong ids, changed context, values outside the vocabulary, blanks."""
    spark = sheet.sparkSession
    missing = sorted(set(template.columns) - set(sheet.columns))
    if missing:
        return spark.createDataFrame([("schema", f"{label} lacks {', '.join(missing)}")], "gate string, detail string")
    out = []
    dup = sheet.groupBy(*key).count().where("count > 1").select(F.lit("duplicate_id").alias("gate"), F.concat_ws(",", *key).alias("detail"))
    out.append(dup)
    for a, b, name in ((sheet, template, "unknown_id"), (template, sheet, "missing_id")):
        out.append(key_difference(a, b, key).select(F.lit(name).alias("gate"), F.concat_ws(",", *key).alias("detail")))
    if context:
        text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
        j = sheet.alias("s").join(template.alias("t"), key)
        changed = reduce(lambda x, y: x | y, [text(F.col(f"s.{c}")) != text(F.col(f"t.{c}")) for c in context])
        out.append(j.where(changed).select(F.lit("changed_context").alias("gate"), F.concat_ws(",", *key).alias("detail")))
    for c, allowed in vocabulary.items():
        v = normalized_enum(F.col(c))
        out.append(sheet.where(~v.isin(*allowed)).select(F.when(v == "", "blank").otherwise("vocabulary").alias("gate"), F.concat_ws(":", *key, F.lit(c)).alias("detail")))
    return reduce(DataFrame.unionByName, out)


def finalize_sheet(sheet: DataFrame, template: DataFrame, key: list[str], context: list[str], vocabulary: dict[str, tuple[str, ...]], label: str = "sheet") -> tuple[str, DataFrame, DataFrame | None]:
    """(status, issues, coded rows); any issue means that people are awaited and nothing is returned."""
    issues = sheet_issues(sheet, template, key, context, vocabulary, label).cache()
    done = issues.isEmpty()
    return (COMPLETED if done else AWAITING), issues, sheet if done else None


def finalize_two_stage(stage_a: DataFrame, stage_b: DataFrame, key: str = "case_id") -> tuple[str, DataFrame, DataFrame | None]:
    """Both stages joined one to one, if their ids agree."""
    gap = key_difference(stage_a, stage_b, [key]).withColumn("gate", F.lit("missing_in_b")).unionByName(key_difference(stage_b, stage_a, [key]).withColumn("gate", F.lit("missing_in_a")))
    dup = stage_a.select(key).unionAll(stage_b.select(key)).groupBy(key).count().where("count > 2").select(key, F.lit("duplicate_id").alias("gate"))
    issues = gap.unionByName(dup)
    if not issues.isEmpty():
        return AWAITING, issues, None
    return COMPLETED, issues, stage_a.join(stage_b, key)


def conditional_gates(spark, gates: list[tuple[str, bool, str]]) -> DataFrame:
    """One row per optional analysis: available or why not."""
    return spark.createDataFrame([(n, "available" if ok else "unavailable", "" if ok else why) for n, ok, why in gates], "analysis string, status string, reason string")
