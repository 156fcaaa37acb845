"""Session helpers: a local session for tests and benches, and the shared
checkpoint folder used to cut lineage between the passes of an analysis."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "tablelens") -> SparkSession:
    """A local session configured the way the tests and the bench expect."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting must name a shared folder and is used as is.
    Only a local session without the setting gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running an analysis")
        configured = tempfile.mkdtemp(prefix="tablelens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return configured


def materialize(df: DataFrame, *parts: str) -> tuple[DataFrame, str]:
    """Write ``df`` once as Parquet under the shared checkpoint folder (in folders
    by the columns ``parts``) and return (a DataFrame that reads it back, the folder).

    This cuts the lineage like ``checkpoint()`` (a lost executor re-reads the
    files instead of recomputing the plan) but computes the plan only once
    (an eager RDD checkpoint of an uncached plan runs it twice) and the later
    passes get Parquet column pruning and filter pushdown."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tablelens-{uuid.uuid4().hex}"
    if parts:  # (without rows there are no folders to read the schema from)
        df.write.mode("error").partitionBy(*parts).parquet(path)
        return spark.read.schema(df.schema).parquet(path), path
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path), path


def release(spark: SparkSession, path: str | None) -> bool:
    """Delete a folder written by ``materialize`` (through the Hadoop file
    system of the path, so it works for any shared store)."""
    if not path:
        return False
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(p, True))
