"""Bucket digests: skip equal parts of two snapshots before comparing their rows.

Keys fall into buckets by hash, so an entry's bucket never changes. A bucket's digest sums a 128-bit hash of its entries: it
doesn't depend on order and two buckets with equal digests and counts hold the same entries. A stored snapshot keeps its digests, so
comparing two of them reads rows of unequal buckets only (partition pruning when stored by bucket). The number of buckets is a
power of two that grows with the rows; as digests are sums, those of a finer division add up to those of a coarser one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.operators import setops

BUCKETS = 64
ROWS_PER_BUCKET = 1 << 20


def buckets_for(rows: int, least: int = BUCKETS) -> int:
    """The least power-of-two multiple of `least` that keeps buckets below ROWS_PER_BUCKET rows on average."""
    n = least
    while rows > n * ROWS_PER_BUCKET:
        n *= 2
    return n


def bucket(key: Column, n: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def bucket_digests(snapshot: DataFrame, n: int = BUCKETS) -> DataFrame:
    """bucket, rows, digest of a snapshot (key, value)."""
    half = lambda seed: F.sum(F.xxhash64(F.lit(seed), "key", F.hash(F.lit(seed), "value"), "value").cast("decimal(38,0)"))
    return snapshot.groupBy(bucket(F.col("key"), n).alias("bucket")).agg(F.count("*").alias("rows"), F.concat_ws(":", half(1), half(2)).alias("digest"))


def folded(digests: DataFrame, n: int) -> DataFrame:
    """Digests of a division into n buckets from those of a finer one."""
    half = lambda i: F.sum(F.split("digest", ":")[i].cast("decimal(38,0)"))
    return digests.groupBy(F.pmod("bucket", F.lit(n)).alias("bucket")).agg(F.sum("rows").alias("rows"), F.concat_ws(":", half(0), half(1)).alias("digest"))


def changed_buckets(left: DataFrame, right: DataFrame) -> list[int]:
    """Buckets whose digests differ; at most the number of buckets."""
    same = F.col("l.digest").eqNullSafe(F.col("r.digest")) & F.col("l.rows").eqNullSafe(F.col("r.rows"))
    both = left.alias("l").join(right.alias("r"), F.col("l.bucket") == F.col("r.bucket"), "full_outer")
    return sorted(r[0] for r in both.where(~same).select(F.coalesce("l.bucket", "r.bucket")).collect())


def pruned_diff(old: DataFrame, new: DataFrame, old_digests: DataFrame | None = None, new_digests: DataFrame | None = None, n: int = BUCKETS) -> DataFrame:
    """setops.diff() of the buckets that differ."""
    changed = changed_buckets(old_digests or bucket_digests(old, n), new_digests or bucket_digests(new, n))
    side = lambda d: d.where((F.col("bucket") if "bucket" in d.columns else bucket(F.col("key"), n)).isin(changed) if changed else F.lit(False)).select("key", "value")
    return setops.diff(side(old), side(new))
