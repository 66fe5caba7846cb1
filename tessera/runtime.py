"""Session helpers: the shared folder for intermediate tables, and input sizes."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one that the cluster names in ``spark.checkpoint.dir``. Only
    where that is unset (local runs and tests) a folder of our own is made,
    registered with the context, and removed when Python ends.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "/tmp/checkpoints"
        os.makedirs(base, exist_ok=True)
        own = tempfile.mkdtemp(prefix="tessera-", dir=base)
        atexit.register(shutil.rmtree, own, True)
        at = f"file://{own}"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where the driver found it (on a cluster it is installed or shipped)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, have]))
    return spark


_COLLECTED = [0.0]


def tidy(spark: SparkSession, seconds: float) -> None:
    """Let Spark remove shuffle files and plans that nothing refers to; not again within ``seconds``."""
    if time.monotonic() - _COLLECTED[0] >= seconds:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _COLLECTED[0] = time.monotonic()


class Workspace:
    """Intermediate tables of one query, written to the shared folder.

    A written table cuts the lineage: a lost executor re-reads it instead of
    recomputing what led to it. ``drop`` removes a table that no later plan
    reads; what the returned DataFrame still reads stays until Python ends.
    """

    def __init__(self, spark: SparkSession, rest: float = 0.0):
        """``rest``: seconds between clearings of shuffle files, for work in many small tables."""
        self.spark, self.rest = spark, rest
        self.root = f"{shared_dir(spark)}/ws-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self._delete, self.root)

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` as Parquet and return it as read back."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        tidy(self.spark, self.rest)
        out._tessera_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table made by ``keep``; nothing may read it afterwards."""
        path = getattr(df, "_tessera_path", None)
        if path:
            self._delete(path)

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is not None:  # a stopped session no longer reaches the folder
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def text_bytes(df: DataFrame, column: str) -> int:
    """Bytes of all values of a string column (one scan of that column)."""
    got = df.agg(F.sum(F.octet_length(column)).alias("n")).first()
    return int(got["n"] or 0)


def parts_for(n_bytes: int, target: int, least: int = 1) -> int:
    """How many parts of about ``target`` bytes hold ``n_bytes``."""
    return max(least, -(-n_bytes // target))


def tasks_for(n_bytes: int, target: int = 16 << 20, most: int = 20_000) -> int:
    """Partitions of an exchange of ``n_bytes`` of text: of about ``target`` bytes each, and larger ones past ``most``."""
    return min(most, parts_for(n_bytes, target, 8))
