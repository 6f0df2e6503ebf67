"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import pathlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.session import written

__all__ = ["ARROW_ROWS", "ascii_lower", "prepare", "texts_of", "written"]

# Rows of whole texts that a Python worker holds at a time.
ARROW_ROWS = 500


def prepare(spark: SparkSession, rows: int = ARROW_ROWS) -> SparkSession:
    """Let Python workers import this package, and keep their batches of texts small.

    On a cluster the package is shipped with --py-files or installed; where workers run
    on this machine, the folder it was loaded from is enough.
    """
    root = str(pathlib.Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    known = [path for path in environment.get("PYTHONPATH", "").split(os.pathsep) if path]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text; a null text is empty."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
