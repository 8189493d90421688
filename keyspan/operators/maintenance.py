"""Maintenance of an object table: garbage, integrity, and what one store lacks of another."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.schema import content_hash


def roots(refs: DataFrame, working: DataFrame | None = None, extra: DataFrame | None = None) -> DataFrame:
    """hash of everything that keeps objects alive: branch and tag tips, working trees, and extra pins such as a detached head."""
    out = refs.where(F.col("kind").isin("branch", "tag")).select(F.col("commit").alias("hash"))
    for more in (working, extra):
        if more is not None:
            out = out.unionByName(more.select("hash"))
    return out.where("hash IS NOT NULL").distinct()


def garbage(objects: DataFrame, reachable: DataFrame) -> DataFrame:
    return objects.join(reachable.select("hash"), "hash", "left_anti")


def gc_report(objects: DataFrame, reachable: DataFrame, size: str = "n_bytes") -> DataFrame:
    """total, reachable, deleted, bytes_freed; a dry run and a real one report alike."""
    kept = reachable.select("hash").distinct().withColumn("kept", F.lit(True))
    marked = objects.join(kept, "hash", "left")
    return marked.agg(F.count("*").alias("total"), F.count_if("kept").alias("reachable"), F.count_if(F.col("kept").isNull()).alias("deleted"), F.coalesce(F.sum(F.when(F.col("kept").isNull(), F.col(size))), F.lit(0)).alias("bytes_freed"))


def fsck(reachable: DataFrame, objects: DataFrame) -> DataFrame:
    """hash, problem (missing, corrupt) of reachable objects; every one is loaded and hashed again."""
    found = reachable.select("hash").distinct().join(objects.select("hash", "bytes"), "hash", "left")
    problem = F.when(F.col("bytes").isNull(), "missing").when(content_hash(F.col("bytes")) != F.col("hash"), "corrupt")
    return found.select("hash", problem.alias("problem")).where("problem IS NOT NULL")


def fsck_report(reachable: DataFrame, objects: DataFrame) -> DataFrame:
    """checked, missing, corrupt."""
    bad = fsck(reachable, objects)
    checked = reachable.select("hash").distinct().withColumn("problem", F.lit("checked"))
    both = checked.unionByName(bad)
    return both.agg(*[F.count_if(F.col("problem") == p).alias(p) for p in ("checked", "missing", "corrupt")])


def missing(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """What a sync has to send."""
    return wanted.join(present.select("hash"), "hash", "left_anti")


def transfer(wanted: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """The object rows that target lacks: an append of these makes it complete, a second run adds nothing."""
    return source.join(missing(wanted.select("hash").distinct(), target), "hash", "left_semi")


def export_closure(reachable: DataFrame, objects: DataFrame) -> DataFrame:
    """The objects that a pruned copy of a branch holds."""
    return objects.join(reachable.select("hash").distinct(), "hash", "left_semi")


def dedup(contents: DataFrame, content: str) -> DataFrame:
    """hash, copies, n_bytes of each distinct content."""
    c = F.col(content)
    return contents.groupBy(content_hash(c).alias("hash")).agg(F.count("*").alias("copies"), F.first(F.octet_length(c)).cast("long").alias("n_bytes"))


def send_batches(objects: DataFrame, per: str = "peer", cap: int = 512 * 1024) -> DataFrame:
    """peer, hash, n_bytes, batch: in hash order, each batch the longest run under the cap and at least one object.

    A batch depends on all before it, so the fold streams over each peer's sorted rows and keeps one running sum.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        peer, batch, total = None, 0, 0
        for part in batches:
            out = []
            for p, n in zip(part[per], part["n_bytes"], strict=True):
                if p != peer:
                    peer, batch, total = p, 0, 0
                elif total + n > cap:
                    batch, total = batch + 1, 0
                total += n
                out.append(batch)
            yield part.assign(batch=out)

    rows = objects.select(F.col(per).cast("string").alias(per), "hash", F.col("n_bytes").cast("long").alias("n_bytes"))
    return rows.repartition(per).sortWithinPartitions(per, "hash").mapInPandas(fold, f"{per} string, hash string, n_bytes long, batch int")
