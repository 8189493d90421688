"""Snapshots: DataFrames with unique keys. Lookups, scans, paging and batched changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.functions.scalars import is_hex_prefix
from keyspan.schema import stored_value


def get(snapshot: DataFrame, key, column: str = "key") -> DataFrame:
    return snapshot.where(F.col(column) == F.lit(key))


def get_many(snapshot: DataFrame, keys: DataFrame, column: str = "key") -> DataFrame:
    """Rows whose key is among the keys: one semi-join for a whole batch of lookups."""
    return snapshot.join(keys.select(column), column, "left_semi")


def scan(snapshot: DataFrame, column: str = "key") -> DataFrame:
    return snapshot.orderBy(column)


def scan_prefix(snapshot: DataFrame, prefix: str, column: str = "key") -> DataFrame:
    """Keys that start with the prefix; reaches the Parquet scan as a filter on the files' ranges."""
    return snapshot.where(F.col(column).startswith(prefix)) if prefix else snapshot


def seek(snapshot: DataFrame, key, column: str = "key") -> DataFrame:
    """First entry at or after the key."""
    return snapshot.where(F.col(column) >= F.lit(key)).orderBy(column).limit(1)


def page_after(snapshot: DataFrame, key, n: int, column: str = "key") -> DataFrame:
    """The n entries after the key, in order: paging without offsets."""
    return (snapshot.where(F.col(column) > F.lit(key)) if key is not None else snapshot).orderBy(column).limit(n)


def count(snapshot: DataFrame) -> DataFrame:
    return snapshot.agg(F.count("*").alias("n"))


def find_by_prefix(objects: DataFrame, prefix: str) -> DataFrame:
    """Objects by a hex prefix of their address; a prefix that isn't hex finds none, '' finds all."""
    if prefix == "":
        return objects
    return objects.where(is_hex_prefix(F.lit(prefix)) & F.col("hash").startswith(prefix.lower()))


def bulk_build(entries: DataFrame, order: list[Column], key: list[str] | None = None) -> DataFrame:
    """Last-wins snapshot of entries in the given order: one combining aggregation, no window over a key's rows."""
    keys = key or ["key"]
    rest = [c for c in entries.columns if c not in keys]
    numbered = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    last = F.max(F.struct(*numbered, *[F.col(c) for c in rest])).alias("last")
    return entries.groupBy(*keys).agg(last).select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest])


def put_many(snapshot: DataFrame, changes: DataFrame, key: str = "key") -> DataFrame:
    """Upsert: rows of changes replace those of the snapshot. Keys of changes are unique (see bulk_build)."""
    return snapshot.join(changes.select(key), key, "left_anti").unionByName(changes.select(snapshot.columns))


def delete_many(snapshot: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Without the keys; keys that aren't there change nothing."""
    return snapshot.join(keys.select(key), key, "left_anti")


def store_values(rows: DataFrame, content: str) -> tuple[DataFrame, DataFrame]:
    """(rows with `value` = struct(inline, external) instead of the content, objects that the external ones need)."""
    valued = rows.withColumn("value", stored_value(F.col(content)))
    big = valued.where(F.col("value.external").isNotNull())
    objects = big.groupBy(F.col("value.external").alias("hash")).agg(F.first(F.col(content).cast("binary")).alias("bytes"))
    return valued.drop(content), objects


def load_values(rows: DataFrame, objects: DataFrame) -> DataFrame:
    """rows with `content`, and `status` ok or missing; only external values meet the object table."""
    found = rows.join(objects.select(F.col("hash").alias("_h"), F.col("bytes").alias("_b")), F.col("value.external") == F.col("_h"), "left")
    content = F.coalesce(F.col("value.inline"), F.col("_b"))
    return found.withColumn("content", content).withColumn("status", F.when(content.isNotNull(), "ok").otherwise("missing")).drop("_h", "_b")
