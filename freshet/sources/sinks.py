"""Writing products, resuming and stacking them."""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def not_done(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not in the output yet. Ids compare as strings.

    Apply it to the gage list or the daily rows before any computation.
    """
    done = existing.select(*[F.col(k).cast("string").alias(f"_done_{k}") for k in keys]).distinct()
    same = None
    for k in keys:
        match = F.col(k).cast("string") == F.col(f"_done_{k}")
        same = match if same is None else same & match
    return new.join(done, same, "left_anti")


def union_fill(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stack two tables by column name; columns missing on one side are null."""
    return a.unionByName(b, allowMissingColumns=True)


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_per_key(
    source: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, key: str, batch: int = 64, most: int | None = None
) -> DataFrame:
    """Writes compute(source) under path, one folder per value of key, and reads it back.

    The keys (initialisations, runs: as many as a calendar has) go through compute in order,
    `batch` of them a job. A job replaces only the folders of its own keys, and they enter the
    ledger (_done under path) after it, so a run that was stopped, or was allowed only `most`
    jobs, goes on with the keys that the ledger lacks and repeats at most one job.
    """
    spark = source.sparkSession
    ledger = f"{path}/_done"
    todo = source.select(key).filter(F.col(key).isNotNull()).distinct()
    if _exists(spark, ledger):
        todo = not_done(todo, spark.read.parquet(ledger), [key])
    keys = sorted(r[0] for r in todo.collect())
    for job, at in enumerate(range(0, len(keys), batch)):
        if job == most:
            break
        own = keys[at : at + batch]
        rows = compute(source.filter(F.col(key).isin(own)))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
        names = spark.createDataFrame([(str(k),) for k in own], f"{key} string")
        names.coalesce(1).write.mode("append").parquet(ledger)
    return spark.read.option("basePath", path).parquet(path)


def write_forecast(product: DataFrame, path: str, fmt: str = "parquet", keys: Sequence[str] = ("basin",)) -> None:
    """All basins and both kinds in one dataset, one folder per basin."""
    writer = product.repartition(*keys).write.mode("overwrite").partitionBy(*keys)
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path))


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Score and skill tables."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path))
