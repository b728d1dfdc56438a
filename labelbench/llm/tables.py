"""Reading the tables and cutting plans, shared by the operators of this subpackage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelbench.session import cut_lineage

__all__ = ["read", "cut_lineage", "id_and_text", "rows_of", "batch"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that text operators read, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def rows_of(table: pa.RecordBatch, *names: str):
    """Python values of the columns, row by row; None stands for null."""
    return zip(*(table.column(n).to_pylist() for n in names))


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
