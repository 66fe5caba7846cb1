"""Settings and state files, read on the driver and checked against what is known."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from tessera.operators.relational import ContractError

#: Every top-level section of a study's settings.
SECTIONS = {"quality", "splits", "models", "bootstrap", "equivalence", "narratives", "topic_model", "paths", "datasets"}


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, by Spark's own readers (any store)."""
    row = spark.read.text(path, wholetext=True).first()
    return row[0] if row else ""


def load_json(spark: SparkSession, path: str) -> dict:
    """A state file such as the pointer to the latest run."""
    got = json.loads(read_text(spark, path))
    if not isinstance(got, dict):
        raise ContractError(f"{path} holds no object")
    return got


def load_yaml(spark: SparkSession, path: str) -> dict:
    """A settings file; an empty one has no settings, an unknown section is an error."""
    try:
        import yaml
    except ImportError as x:
        raise ContractError("YAML settings need the yaml package; JSON needs none") from x
    got = yaml.safe_load(read_text(spark, path)) or {}
    unknown = sorted(set(got) - SECTIONS)
    if unknown:
        raise ContractError(f"unknown sections: {', '.join(unknown)}")
    return got


def folders_exist(spark: SparkSession, root: str, names: tuple[str, ...] = ("user_followers", "user_following")) -> bool:
    """Whether all optional folders are there."""
    jvm = spark.sparkContext._jvm
    for n in names:
        p = jvm.org.apache.hadoop.fs.Path(f"{root}/{n}")
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return False
    return True
