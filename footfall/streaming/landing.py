"""Export files arriving in a landing folder, ingested by Structured Streaming."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from footfall.functions.times import Instant
from footfall.sources.exports import literal_path
from footfall.sources.store import Store

# The schema the binary file source has; naming it lets the stream start on an empty folder.
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
FILES_PER_BATCH = 1000


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def ingest_landing(
    spark: SparkSession,
    landing: str,
    store: Store,
    site: str,
    checkpoint: str,
    files_per_batch: int = FILES_PER_BATCH,
    clock: Callable[[], Instant] = utc_now,
    last_hit_id: Callable[[list[str]], int | None] = lambda names: None,
    **export_options,
) -> StreamingQuery:
    """Sync every file not seen before, then stop.

    The stream carries file names only: exports may differ in their headers, so each
    batch of files goes through the batch reader. The checkpoint remembers the files;
    a batch repeated after a failure inserts nothing twice and is noted once, by the
    checkpoint and its number there. ``last_hit_id`` tells the cursor that came with the
    files of a batch.
    """

    def sync_files(batch: DataFrame, batch_id: int) -> None:
        # At most files_per_batch names.
        names = [literal_path(row.path) for row in batch.collect()]
        if names:
            origin = f"{checkpoint}#{batch_id}"
            cursor = last_hit_id(names)
            store.sync(batch.sparkSession, names, site, clock(), cursor, origin, **export_options)

    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", True)
        .load(landing)
        .select("path")
    )
    return (
        files.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(sync_files)
        .start()
    )
