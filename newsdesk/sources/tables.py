"""State tables: Parquet folders of one partition per batch, written before they are read.

A batch that is run again overwrites its own partition, so a retry changes nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession


def one_row(spark: SparkSession, **values: Column) -> DataFrame:
    """A one-row table in one partition, so that it is written as one file."""
    return spark.range(0, 1, 1, 1).select(*[v.alias(name) for name, v in values.items()])


class BatchTable:
    """Rows by ``batch_id`` under one folder; an absent folder is an empty table."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def scan(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self.scan(self.path, f"{self.schema}, batch_id BIGINT")

    def at(self, batch_id: int) -> DataFrame:
        """Rows of one batch, without listing the others."""
        return self.scan(f"{self.path}/batch_id={batch_id}", self.schema)

    def has(self, batch_id: int) -> bool:
        return not self.at(batch_id).isEmpty()

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")
