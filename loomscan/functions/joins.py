"""Hints for joins whose sides grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def sorted_side(df: DataFrame) -> DataFrame:
    """A side that is never broadcast. Spark guesses the size of exploded or parsed rows from the table they come from, far too
    low, and a broadcast passes through the driver."""
    return df.hint("merge")
