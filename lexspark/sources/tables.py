"""Reading the tables of a data folder, one Parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table, pruned to the given columns if any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def register_views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views by table name, for free SQL over the data."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def dedup_deliveries(df: DataFrame, key: str) -> DataFrame:
    """One row per key; rows delivered twice are equal in all columns, so any one may stay.

    Rows with a null key are all kept, as nothing says that they are the same row.
    """
    return df.filter(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(df.filter(F.col(key).isNull()))
