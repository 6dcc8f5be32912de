"""Intermediate tables in the folder that all executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset a temporary folder takes its place in a local session; on a cluster, whose
    machines would not see each other's, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='orbitframe-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def landed(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    What reads it plans and runs on its own, and survives lost executors.
    """
    folder = f"{shared_folder(df.sparkSession)}/orbitframe-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
