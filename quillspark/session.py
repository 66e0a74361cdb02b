"""Session helpers: local sessions for tests, durable cut points, broadcasts behind a size check."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows times its row width stay under this.
BROADCAST_BYTES = 32 << 20


def cluster_session(name: str = "quillspark") -> SparkSession:
    """The session that runs already or that spark-submit has configured; a local one only where no master is named."""
    if SparkSession.getActiveSession() is None and not SparkConf().contains("spark.master"):
        return local_session(name=name)
    return SparkSession.builder.appName(name).getOrCreate()


def local_session(cpus: int | str = "*", name: str = "quillspark", **conf: str) -> SparkSession:
    b = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("QUILL_DRIVER_MEMORY", "8g"),
        "spark.sql.adaptive.enabled": "true",
    }
    for k, v in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core. Only inputs of fewer partitions than cores are moved, which are small ones."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; only a local session that names none gets a temporary folder, removed when Python ends."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="quillspark-checkpoint-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)
        known = sc._jsc.sc().getCheckpointDir()
    return known.get()


def durable(df: DataFrame) -> DataFrame:
    """Materialise in the cluster's shared checkpoint folder and cut the lineage. Lost executors cost nothing already written."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Removes the shuffle files of a statement when it ends, where the Spark version knows it.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """Like durable, but as a Parquet table of its own, which release() deletes; the exchanges that led to it are deleted at once.

    For steps of iterative jobs: disks hold the current step and not all the earlier ones.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(folder)
    out._written = folder
    return out


def release(df: DataFrame) -> None:
    """Delete what written() made. Nothing that reads it may be evaluated afterwards."""
    folder = df.__dict__.get("_written")
    if folder is not None:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the counted rows of df fit the broadcast limit; `row_bytes` is the width of one row in memory."""
    most = limit // max(1, row_bytes)
    return df.select(F.lit(1).alias("one")).limit(most + 1).count() <= most


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint where the side is proven small; otherwise the plain side, for a shuffled join."""
    return F.broadcast(df) if small_enough(df, row_bytes, limit) else df


#: Parts that the rows of one key are spread over where a side is too large to be broadcast.
SALTS = 64


def join_spread(big: DataFrame, small: DataFrame, keys: list[str], row_bytes: int, by: str, how: str = "inner") -> DataFrame:
    """big joined with at most one row of `small` per key, however many rows of big a key has: by broadcast if small is proven small, else
    with the rows of a key spread by a hash of column `by` and the rows of small sent to every part. Keys must not be null to match."""
    if small_enough(small, row_bytes):
        return big.join(F.broadcast(small), keys, how)
    parts = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(parts, [*keys, "_salt"], how).drop("_salt")
