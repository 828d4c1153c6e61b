"""Reading and writing tables and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planshift.session import shared_folder


def lower_names(df: DataFrame) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(c.lower()) for c in df.columns])


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Catalog table, or parquet when ``name`` is a path.  Column names come back in lower case."""
    source = spark.read.parquet(name) if "/" in name else spark.table(name)
    return lower_names(source)


def snapshot(df: DataFrame, period: str, column: str = "ym") -> DataFrame:
    """One period of a table that holds all period snapshots; prunes when ``column`` is a partition."""
    return df.filter(F.col(column) == period)


def previous_month(period: str) -> str:
    """``YYYYMM`` of the month before."""
    year, month = int(period[:4]), int(period[4:])
    return f"{year - 1}12" if month == 1 else f"{year}{month - 1:02d}"


def dated_partitions(df: DataFrame, year: int, first_month: int, after_day: int = 0) -> DataFrame:
    """Rows of a table partitioned by ``year`` / ``month`` / ``date`` parts."""
    return df.filter(
        (F.col("year") == year) & (F.col("month") >= first_month) & (F.col("date") > after_day)
    )


def materialize(
    df: DataFrame,
    target: str,
    partition_by: Sequence[str] = (),
    bucket_by: Sequence[str] = (),
    buckets: int = 0,
) -> DataFrame:
    """Write ``df`` as parquet and hand back a scan of what was written.

    ``target`` is a path, or the name of a catalog table.  A table can be bucketed: tables
    with the same buckets on the same keys then join on them without a shuffle.  Take keys
    without hot values, such as (account, day), since a bucket is read by one task.

    The rows are rebalanced on those columns first: adaptive execution then writes few
    files per folder or bucket and still splits one that holds most rows.
    """
    spark = df.sparkSession
    clustered = [*partition_by, *bucket_by]
    rows = df.hint("rebalance", *clustered) if clustered else df
    writer = rows.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if "/" in target:
        writer.parquet(target)
        return spark.read.schema(df.schema).parquet(target).select(df.columns)
    if bucket_by:
        writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    writer.saveAsTable(target)
    return spark.table(target).select(df.columns)


def replace_partitions(df: DataFrame, target: str, partition_by: Sequence[str]) -> DataFrame:
    """Write the partitions that ``df`` has rows of, and leave all others of the table as they are.

    This is how a job is run again for one month: its old rows go, whole, and no other month is
    read or written.  A partition without rows in ``df`` stays.  ``target`` is a path or the name of
    a catalog table; where it does not exist yet it is made.  Returns a scan of the whole table.
    """
    spark, names = df.sparkSession, [*[c for c in df.columns if c not in partition_by], *partition_by]
    if "/" in target:
        rows = df.hint("rebalance", *partition_by)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(target)
        return spark.read.schema(df.schema).parquet(target).select(df.columns)
    if not spark.catalog.tableExists(target):
        return materialize(df, target, partition_by)
    # a catalog table takes columns by place, its partition columns last
    kept = spark.table(target).columns
    if sorted(kept) != sorted(names):
        raise ValueError(f"{target} has the columns {kept}")
    conf = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "dynamic")
    try:
        df.select(kept).hint("rebalance", *partition_by).write.insertInto(target, overwrite=True)
    finally:
        spark.conf.set(conf, before)
    return spark.table(target).select(df.columns)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def pinned(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared folder, so later steps see the same rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
