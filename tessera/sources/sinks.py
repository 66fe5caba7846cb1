"""Writers: Parquet, CSV, strict JSON, markdown; file inventories."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def strict(df: DataFrame) -> DataFrame:
    """NaN and infinities as null, which JSON can say."""
    cols = []
    for c, kind in df.dtypes:
        if kind in ("double", "float"):
            x = F.col(c)
            cols.append(F.when(~F.isnan(x) & (F.abs(x) != math.inf), x).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """CSV with a header; ``single`` for small reports only."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str) -> None:
    strict(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text file, through the file system of its path."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


#: Tables of the shift bundle that have a row a cohort, text or field: the summary holds them whole.
SMALL = ("cohort_profiles", "domain_exclusion_summary", "vocabulary_summary", "document_length_profiles", "document_length_shift", "categorical_shift_summary", "topic_proxy_summary", "shift_summary")


def write_bundle(tables: Mapping[str, DataFrame], root: str) -> None:
    """Parquet per table; of a shift bundle also ``summary.json`` (metadata and small tables, strict) and ``summary.md``."""
    for name, df in tables.items():
        write_parquet(df, f"{root}/{name}")
    metadata = getattr(tables, "metadata", None)
    if metadata is None:
        return
    spark = next(iter(tables.values())).sparkSession
    small = {name: spark.read.parquet(f"{root}/{name}") for name in SMALL if name in tables}
    rows = {name: [r.asDict(recursive=True) for r in strict(df).collect()] for name, df in small.items()}
    write_text(spark, json.dumps(metadata | {"tables": sorted(tables), "summaries": rows}, indent=2, allow_nan=False, default=str) + "\n", f"{root}/summary.json")
    write_text(spark, render_shift(metadata, small), f"{root}/summary.md")


def render_shift(metadata: dict, small: dict[str, DataFrame]) -> str:
    """The small tables of a shift bundle as a markdown report."""
    heads = {
        "cohort_profiles": "Cohorts", "domain_exclusion_summary": "Domains left out", "vocabulary_summary": "Vocabulary", "document_length_profiles": "Document lengths",
        "document_length_shift": "Length shift", "categorical_shift_summary": "Composition", "topic_proxy_summary": "Topics (descriptive, not validated)",
    }
    out = [f"# Shift from {metadata['source_dataset']} to {metadata['target_dataset']}\n", "Descriptive differences between training and test records; none of them shows a cause. Labels of the two datasets are not taken to mean the same.\n"]
    for name, head in heads.items():
        if name in small:
            df = small[name].drop("direction")
            keys = [c for c in ("cohort", "dataset", "text_representation", "field") if c in df.columns]
            out.append(f"## {head}\n\n{markdown_table(df.orderBy(*keys) if keys else df)}")
    return "\n".join(out)


def markdown_table(df: DataFrame) -> str:
    """A pipe table of every row of a report: NA for null, three decimals, bars escaped."""

    def cell(v) -> str:
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "NA"
        return f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|")

    head = "| " + " | ".join(df.columns) + " |\n| " + " | ".join("---" for _ in df.columns) + " |\n"
    return head + "".join("| " + " | ".join(map(cell, r)) + " |\n" for r in df.toLocalIterator())


def read_prefer_parquet(spark: SparkSession, parquet: str, csv: str) -> tuple[DataFrame | None, str]:
    """(table, reason): Parquet, else CSV as text, else None and why."""
    for read in (lambda: spark.read.parquet(parquet), lambda: spark.read.csv(csv, header=True)):
        try:
            return read(), ""
        except Exception as x:  # noqa: BLE001 - Spark raises one class for every missing path
            if "PATH_NOT_FOUND" not in str(x) and "UNABLE_TO_INFER_SCHEMA" not in str(x):
                raise
    return None, "baseline_artifacts_missing"


def inventory(spark: SparkSession, root: str, max_hash_bytes: int = 25_000_000) -> DataFrame:
    """path, suffix, size and SHA-256 of all files below ``root`` (a sentinel instead of the hash of larger ones)."""
    meta = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    meta = meta.where(~F.col("path").rlike(r"/\.git/"))
    small = meta.where(F.col("length") <= max_hash_bytes).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    large = meta.where(F.col("length") > max_hash_bytes).select("path", F.col("length").alias("size"), F.lit("not_hashed_large_file").alias("sha256"))
    return small.unionByName(large).withColumn("suffix", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))


def verify_md5(spark: SparkSession, path: str, md5: str, size: int) -> bool:
    got = spark.read.format("binaryFile").load(path).select(F.md5("content").alias("m"), "length").first()
    return got is not None and got["m"] == md5 and got["length"] == size


def table_inventory(spark: SparkSession, root: str, max_json_bytes: int = 10_000_000) -> tuple[DataFrame, DataFrame]:
    """(tables, fields): path, format, records and status, and the column names, of every CSV, and of every JSON file up to a size.

    Headers are read in one job, records counted in one scan for each kind of
    header, and JSON files parsed where they lie. A JSON file that cannot be
    read is a row with its error.
    """
    from tessera.sources.items import by_header, read_csv

    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    low = F.lower("path")
    csv = [unquote(r["path"]) for r in names.where(low.endswith(".csv")).select("path").collect()]  # names only
    tables = spark.createDataFrame([], "path string, format string, records long, status string")
    fields = spark.createDataFrame([], "path string, field string")
    for own in by_header(spark, csv) if csv else []:
        df = read_csv(spark, own)
        all_ = spark.createDataFrame([(p,) for p in own], "path string")
        n = df.select(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))).alias("path")).groupBy("path").agg(F.count("*").alias("records"))
        plain = F.regexp_replace("path", "^file:/+", "file:/")
        got = all_.withColumn("key", plain).join(n.select(plain.alias("key"), "records"), "key", "left")
        tables = tables.unionByName(got.select("path", F.lit("csv").alias("format"), F.coalesce("records", F.lit(0)).alias("records"), F.lit("ok").alias("status")))
        fields = fields.unionByName(all_.select("path", F.explode(F.array(*map(F.lit, df.columns))).alias("field")))

    def parse(batches):
        for b in batches:
            rows = []
            for path, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    got = json.loads(raw)
                    head = got[:50] if isinstance(got, list) else list(got.values())[:50] if isinstance(got, dict) else []
                    rows.append((path, len(got) if isinstance(got, list | dict) else 1, "ok", sorted({k for x in head if isinstance(x, dict) for k in x})))
                except ValueError as x:
                    rows.append((path, None, f"error: {str(x)[:200]}", []))
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.string()))], ["path", "records", "status", "own"])

    parsed = names.where(low.endswith(".json") & (F.col("length") <= max_json_bytes)).select("path", "content").mapInArrow(parse, "path string, records long, status string, own array<string>")
    tables = tables.unionByName(parsed.select("path", F.lit("json").alias("format"), "records", "status"))
    return tables, fields.unionByName(parsed.select("path", F.explode("own").alias("field")))
