"""Keyed set operations on two snapshots (key, value); each is one equi-join on the key.

A snapshot against itself gives the mathematical result: the intersection and the union are the snapshot, the difference is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer alignment; a null struct means that the side lacks the key, so a null value is no absence."""
    l, r = (d.select("key", F.struct("value").alias(n)) for d, n in ((left, "l"), (right, "r")))
    return l.join(r, "key", "full_outer")


def outer_walk(left: DataFrame, right: DataFrame) -> DataFrame:
    """key, side (left, right, equal, differ), left_value, right_value for every key of either."""
    side = F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").when(F.col("l.value").eqNullSafe(F.col("r.value")), "equal").otherwise("differ")
    return _sides(left, right).select("key", side.alias("side"), F.col("l.value").alias("left_value"), F.col("r.value").alias("right_value"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, change (added, removed, modified), old, new."""
    change = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").otherwise("modified")
    moved = F.col("l").isNull() | F.col("r").isNull() | ~F.col("l.value").eqNullSafe(F.col("r.value"))
    return _sides(old, new).where(moved).select("key", change.alias("change"), F.col("l.value").alias("old"), F.col("r.value").alias("new"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Entries of left whose key right lacks."""
    return left.join(right.select("key"), "key", "left_anti")


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    """Entries with equal key and value in both."""
    r = right.select(F.col("key").alias("_k"), F.col("value").alias("_v"))
    return left.join(r, (F.col("key") == F.col("_k")) & F.col("value").eqNullSafe(F.col("_v")), "left_semi")


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """All keys; right's value wins."""
    return _sides(left, right).select("key", F.coalesce("r", "l")["value"].alias("value"))
