"""Ad-hoc read-only SQL, the self-description of the tables, and JSON output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall import schema
from footfall.operators.visits import visits
from footfall.schema import single_row
from footfall.session import written


def adhoc_sql(hits: DataFrame, sync_state: DataFrame, query: str) -> DataFrame:
    """Run a query over ``hits``, ``sessions`` and ``sync_state``.

    The text becomes a subquery, so only something that returns rows parses; an
    unknown column is reported by name. The names exist for this query only.
    """
    spark = hits.sparkSession
    tables = {"hits": hits, "sessions": visits(hits), "sync_state": sync_state}
    names = {table: f"{table}_{uuid.uuid4().hex}" for table in tables}
    try:
        for table, frame in tables.items():
            frame.createOrReplaceTempView(names[table])
        aliases = ", ".join(f"{table} AS (SELECT * FROM {name})" for table, name in names.items())
        return spark.sql(f"WITH {aliases} SELECT * FROM (\n{query}\n) AS answer")
    finally:
        for name in names.values():
            spark.catalog.dropTempView(name)


def describe(spark: SparkSession) -> DataFrame:
    """Tables, columns, types and what each column means."""
    tables = {
        "hits": schema.HITS,
        "sessions": schema.VISITS,
        "sync_log": schema.SYNC_LOG,
        "sync_state": schema.SYNC_STATE,
    }
    rows = [
        (table, position, field.name, field.dataType.simpleString(), field.metadata["comment"])
        for table, fields in tables.items()
        for position, field in enumerate(fields, 1)
    ]
    return spark.createDataFrame(
        rows, "table_name string, position int, column_name string, data_type string, comment string"
    )


def to_json_rows(frame: DataFrame) -> DataFrame:
    """One JSON object per row; unknown stays ``null`` instead of vanishing."""
    return frame.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_json(frame: DataFrame, path: str) -> None:
    """The rows as JSON lines, written in parallel."""
    frame.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def to_json_array(frame: DataFrame) -> DataFrame:
    """The lines of one JSON array, in order: an object each, with a bracket or comma before
    it, and the closing bracket; ``[]`` for no rows.

    Rows keep the order of the frame. They are written once with their places, as only the
    first of them opens the array, and no task can know alone whether it has that one.
    """
    number = F.monotonically_increasing_id()
    rows = written(to_json_rows(frame).withColumn("number", number), "json-rows")
    first = rows.agg(F.min("number").alias("number")).first().number
    if first is None:
        return single_row(frame.sparkSession).select(F.lit("[]").alias("line"))
    mark = F.when(F.col("number") == first, "[").otherwise(",")
    lines = rows.orderBy("number").select(F.concat(mark, "json").alias("line"))
    return lines.unionByName(single_row(frame.sparkSession).select(F.lit("]").alias("line")))


def write_json_array(frame: DataFrame, path: str) -> None:
    """The rows as text files that are one JSON array when put together by name; written
    in parallel, each line an element."""
    to_json_array(frame).write.mode("overwrite").text(path)
