"""Table sources, sinks and the life cycle of stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

__all__ = [
    "Tables", "read_table", "inline_values", "replace_table", "append_table",
    "update_rows", "delete_rows", "archive_table", "export_ordered",
    "sample_rows",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; zone-less timestamps are read as instants in the
    session time zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    plain = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else df


class Tables:
    """Attribute access to the Parquet tables of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self.spark, self.sf_dir, name)


def inline_values(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small literal table (kernels, grids, bands)."""
    return spark.createDataFrame(list(rows), schema)


def replace_table(df: DataFrame, path: str, partition_by=()) -> DataFrame:
    """Create-or-replace: overwrite the stored table and read it back."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def append_table(df: DataFrame, path: str) -> DataFrame:
    """Add rows to a history or log table and read the whole of it."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def update_rows(df: DataFrame, where: Column, values: dict) -> DataFrame:
    """Copy of the table with ``values`` set where the predicate holds."""
    return df.withColumns({
        c: F.when(where, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c))
        for c, v in values.items()
    })


def delete_rows(df: DataFrame, where: Column) -> DataFrame:
    """Rows for which the predicate is not true (null keeps the row)."""
    return df.filter(~F.coalesce(where, F.lit(False)))


def archive_table(df: DataFrame, path: str, stamp=None) -> DataFrame:
    """Append a dated copy of the table to an archive."""
    stamp = F.current_timestamp() if stamp is None else F.lit(stamp).cast("timestamp")
    return append_table(df.withColumn("archived_date", stamp), path)


def export_ordered(df: DataFrame, path: str, order, fmt: str = "parquet") -> None:
    """Globally ordered export; range partitioned, so no single-task sort."""
    df.orderBy(*order).write.mode("overwrite").format(fmt).option("header", True).save(path)


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Repeatable random sample: the n rows with the smallest keyed hash."""
    digest = F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))
    return df.orderBy(digest, F.col(key)).limit(n)
