from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        # Names that the operators use for what they return, or on the way.
        T.StructField("kept", T.StringType()),
        T.StructField("keep_id", T.StringType()),
        T.StructField("digest", T.LongType()),
        T.StructField("batch", T.StringType()),
        T.StructField("label", T.StringType()),
    ]
)


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text); the other columns are null or noise."""

    def build(*rows):
        full = [(i, t, "x", None, 7, "b", None) for i, t in rows]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture
def rows_of():
    def build(frame, *names):
        names = names or frame.columns
        return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)

    return build
