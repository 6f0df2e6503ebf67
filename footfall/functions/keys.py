"""Content keys of export rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every cell is followed by one zero byte; a key is the first
# 16 hex digits of the row's sha256.
CELL_END = "\0"
KEY_DIGITS = 16


def cells_content(cells: Sequence[Column]) -> Column:
    """What is hashed of a row given all its cells in order."""
    return F.concat(*[F.concat(F.coalesce(cell, F.lit("")), F.lit(CELL_END)) for cell in cells])


def digest(content: Column) -> Column:
    """The whole digest; rows are told apart by it."""
    return F.sha2(content, 256)


def short(row_digest: Column) -> Column:
    """The key a report shows, the beginning of the digest."""
    return F.substring(row_digest, 1, KEY_DIGITS)


def row_key(cells: Sequence[Column]) -> Column:
    """Key of a row given all its cells in file order."""
    return short(digest(cells_content(cells)))
