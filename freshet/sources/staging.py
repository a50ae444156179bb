"""Tables written between the steps of a plan, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Only a local session (tests) may fall back to a temporary folder: on a cluster it
    would be lost with its machine.
    """
    context = spark.sparkContext
    folder = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir", None)
        or context.getCheckpointDir()
    )
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


class Staging:
    """Written tables of one run: they cut lineage, are read as often as needed and outlive executors.

    keep() writes a table and reads it back, replace() also deletes the table that it follows.
    release() deletes all tables but those named; what a returned DataFrame reads stays until
    its owner has read it and clears the folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._staged = len(self.paths)
        self.paths[kept._staged] = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths[df._staged])
            path.getFileSystem(conf).delete(path, True)

    def replace(self, old: DataFrame, new: DataFrame) -> DataFrame:
        kept = self.keep(new)
        self.drop(old)
        return kept
