"""Results that are used several times, and sides whose size a limit bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import shared_dir

BROADCAST_ROWS = 100_000


def bounded(limit: int, df: DataFrame) -> DataFrame:
    """Broadcast rows that a ``LIMIT`` has cut to a small number; with a larger limit the
    planner decides, which shuffles."""
    return F.broadcast(df) if limit <= BROADCAST_ROWS else df


def settled(df: DataFrame) -> DataFrame:
    """Evaluate a result once, into the checkpoint folder, so that it can be used several times."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
