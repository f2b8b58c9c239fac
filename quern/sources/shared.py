"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A new place in the folder the session names for checkpoints. Where none is set, one under /tmp, if all is one process."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise RuntimeError(f"spark.checkpoint.dir is not set, and executors of {master} share no local folder")
        top = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top}/{uuid.uuid4().hex}"


def written(df: DataFrame, **options: object) -> DataFrame:
    """``df`` as a table in the shared folder: short lineage that survives lost executors. options: the writer's.

    The table stands for what it was made of, so the shuffle files behind it go as soon as it is written.
    """
    path, conf = shared_folder(df.sparkSession), df.sparkSession.conf
    before = conf.get(CLEANED, None)
    conf.set(CLEANED, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.unset(CLEANED) if before is None else conf.set(CLEANED, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
