"""Sorted arrays of a row: search by halving, and names for what a lambda uses more than once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used, in lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def by_id(entries: Column) -> Column:
    """An index for ``found``: structs that begin with ``id``, sorted; entries without an id are left out."""
    return F.sort_array(F.filter(entries, lambda e: e["id"].isNotNull()))


def jumps_of(index: Column) -> Column:
    """Powers of two down to one, as many as halve the index to nothing."""
    bits = F.sequence(F.ceil(F.log2(F.size(index) + 1)).cast("int"), F.lit(0), F.lit(-1))
    return F.transform(bits, lambda b: F.pow(F.lit(2), b).cast("int"))


def below(index: Column, jumps: Column, key: Column, finish) -> Column:
    """``finish`` of the place (from 0, or -1) of the last entry that is below the key."""
    return F.aggregate(jumps, F.lit(-1), lambda at, j: F.when(F.get(index, at + j)["id"] < key, at + j).otherwise(at), finish)


def found(index: Column, jumps: Column, key: Column) -> Column:
    """The first entry with this id, or NULL. A search by halving: n references among n blocks cost n log n."""
    return below(index, jumps, key, lambda at: F.when(F.get(index, at + 1)["id"] == key, F.get(index, at + 1)))
