"""Steps written to, and read again from, the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

from newsdesk.session import staging_folder

PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless their path already holds it."""
    context: SparkContext = spark.sparkContext
    if str(PACKAGE.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="newsdesk-package-")) / "newsdesk.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder: computed once, and safe from lost executors; it goes with the application."""
    spark = df.sparkSession
    path = f"{staging_folder(spark, f'llm-{name}')}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
