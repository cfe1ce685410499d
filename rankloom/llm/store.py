"""Where intermediate tables go: the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder of our own in local mode and an error on a cluster."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        own = got.get() if got.isDefined() else None
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="rankloom-")
        spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: lineage ends here and lost executors cost nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets Spark drop the shuffle files of what is now written
    return spark.read.schema(df.schema).parquet(path)
