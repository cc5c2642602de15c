"""Session defaults and staging of intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library expects; `conf` wins over the defaults."""
    builder = SparkSession.builder.appName("freshness")
    if master:
        builder = builder.master(master)
    for name, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named in `spark.checkpoint.dir`.

    Only a local session may fall back to a folder of its own: on a cluster a
    machine-local path would be lost with the machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="freshness-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir()


def stage(df: DataFrame, **options) -> DataFrame:
    """Write `df` as Parquet under the checkpoint folder, with options of the writer, and read it back.

    Cuts the lineage, survives executor loss, and pins columns that a second
    evaluation could number differently (partition ids, random draws).
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/stage-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Remove the folder of a staged table that nothing reads any more; `df` may be a selection of its rows and columns."""
    spark = df.sparkSession
    for folder in {os.path.dirname(file) for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage_by(df: DataFrame, key: str) -> DataFrame:
    """`stage` as a table in buckets by `key`: joins by `key` move the other side to these rows and never shuffle them.

    One bucket for each shuffle partition. `df` comes dealt by `key` (`repartition`, or a join with such a table), or every task writes a file a bucket.
    """
    spark = df.sparkSession
    name = f"stage_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).option("path", f"{checkpoint_root(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
