"""Tables and exports: the shared folder, the result index, CSV and JSON rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from undula.operators.index import merge_index
from undula.operators.sized import shared_base

INDEX = "root string, path string, kind string, analysis_version int, mtime_ns long, size long, level string"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; only a local master may fall back to a temporary folder."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The stored index; empty if there is none yet."""
    try:
        return spark.read.schema(INDEX).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], INDEX)


def save_index(index: DataFrame, fresh: DataFrame, path: str) -> str:
    """Write the merged index as a new version beside the old one and return its path; readers of the old one are not disturbed."""
    new = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    merge_index(index, fresh).write.parquet(new)
    return new


def export_csv(rows: DataFrame, path: str, *, sep: str = ";", quote_all: bool = False) -> None:
    """``;`` as the command line writes it, or all fields quoted as the listing does."""
    rows.write.option("header", True).option("sep", sep).option("quoteAll", quote_all).option("escape", '"').csv(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
