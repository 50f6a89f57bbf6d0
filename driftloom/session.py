"""Session helpers: a local session for tests, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, scratch: str | None = None) -> SparkSession:
    """Session of one machine for tests and the bench, with its own scratch folder; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("driftloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("DRIFTLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", scratch or tempfile.mkdtemp(prefix="driftloom-"))
        .getOrCreate()
    )


def small_methods(spark: SparkSession) -> None:
    """Keep very long projections fast, unless the session already says otherwise.

    The JVM does not compile methods above 8000 bytes of bytecode.  Spark's documentation
    advises this limit for such a JVM: a stage whose fused method would be longer is generated
    as many short methods instead, about ten times as fast for a wide generated table.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name, "65535") == "65535":
        spark.conf.set(name, "8000")


def shared_root(spark: SparkSession) -> str:
    """The shared folder the session names; without one, a folder below the session's warehouse.

    Both are folders that all executors of a cluster share.  The session is not changed.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/driftloom-scratch"
    return root.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_root(spark)}/driftloom-{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that its lineage ends there.

    A written table survives the loss of any executor and, unlike a cached one, needs no memory.
    """
    path = fresh_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
