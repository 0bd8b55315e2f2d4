"""Invoice analytics on Spark: typed tables in, DataFrames out."""

from ledgerloom.lake import Lake

__all__ = ["Lake"]
