"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = ["append_columns", "cut", "free_name", "read", "shared_folder", "text_column", "utf8"]

#: Rows in one Arrow batch: texts are long, so the default of ten thousand would hold too many bytes.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a temporary one for a session in one process; on a
    cluster that is an error, since executors would not see each other's files.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/cairn-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: computed once, kept when an
    executor is lost, and free of the partitioning they were made with, so that
    a later join deals both of its sides and adaptive execution can split a hot key."""
    at = shared_folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def text_column(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        raise ValueError(f"no column {name}")
    return df


def free_name(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column: pa.Array) -> list:
    """UTF-8 bytes of each text, None for null."""
    return column.cast(pa.binary()).to_pylist()


def append_columns(df: DataFrame, needs: list[str], made: T.StructType, fn: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """``df`` with the columns that ``fn`` makes of each Arrow batch.

    ``fn`` gets a batch of the ``needs`` columns and returns one list or Arrow
    array for each field of ``made``. Columns of ``df`` that carry such a name
    (in any case) are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    df = df.drop(*made.names)
    schema = T.StructType([*df.schema.fields, *made.fields])
    types = list(to_arrow_schema(made).types)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                new = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(fn(b.select(needs)), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], names=names)

    return df.mapInArrow(run, schema)


def quoted(name: str):
    return F.col(f"`{name}`")
