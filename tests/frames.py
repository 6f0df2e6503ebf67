"""Helpers of the tests that are no fixtures."""

from __future__ import annotations

import pathlib

ROOT = pathlib.Path(__file__).resolve().parents[1]


def rows(frame, *columns):
    """Rows as plain tuples in the frame's order."""
    picked = frame.select(*columns) if columns else frame
    return [tuple(row) for row in picked.collect()]


def one(frame):
    [row] = frame.collect()
    return row
