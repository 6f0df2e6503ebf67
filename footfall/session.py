"""Session defaults and the shared folder for written intermediate tables."""

from __future__ import annotations

import functools
import math
import os
import pathlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Sizes a task can take on.
SHUFFLE_BYTES = 256 * 2**20
MIN_SHUFFLE_PARTITIONS = 200


def size_settings(input_bytes: int) -> dict[str, str]:
    """Shuffle size for jobs over this much data; tasks stay as large as they are.

    Adaptive execution only ever merges partitions, so a shuffle has to start with
    enough of them for the largest job; small ones are folded at run time.
    """
    wanted = math.ceil(input_bytes / SHUFFLE_BYTES)
    return {"spark.sql.shuffle.partitions": str(max(wanted, MIN_SHUFFLE_PARTITIONS))}


def build_session(
    app_name: str = "footfall",
    master: str | None = None,
    input_bytes: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session with the settings the library is tuned for.

    Times are text in UTC, so the session zone is pinned. ``input_bytes`` sizes scans
    and shuffles for the data at hand; settings given by name win.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        **(size_settings(input_bytes) if input_bytes else {}),
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the one the cluster shares (spark.checkpoint.dir).

    Only a session whose executors are threads of the driver, as in a test, may be
    without that setting; it gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = _local_root()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package.

    On a cluster it is shipped with --py-files or installed; where workers run on this
    machine, the folder it was loaded from is enough.
    """
    root = str(pathlib.Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    known = [path for path in environment.get("PYTHONPATH", "").split(os.pathsep) if path]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="footfall-")


# Shuffles of a query are removed when it ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the shared folder, read again: lineage ends here, and a
    lost executor costs no more than the tasks it ran. What was shuffled for it goes at once."""
    spark = frame.sparkSession
    folder = shared_folder(spark, purpose)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        frame.write.parquet(folder)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(frame.schema).parquet(folder)
