"""Three-way merge of snapshots with classified conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.functions.paths import strict_ancestors

CONFLICTS = ("both modified", "modify/delete", "delete/modify", "both added", "file/directory")


def align(base: DataFrame, ours: DataFrame, theirs: DataFrame, value: str = "value") -> DataFrame:
    """key with structs b, o, t (null: absent): one shuffle, a tagged union and a combining aggregation."""
    tagged = [d.select("key", *[(F.struct(value) if i == j else F.lit(None)).cast(f"struct<{value}:{d.schema[value].dataType.simpleString()}>").alias(n) for j, n in enumerate("bot")]) for i, d in enumerate((base, ours, theirs))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy("key").agg(*[F.first(n, ignorenulls=True).alias(n) for n in "bot"])


def classify(aligned: DataFrame) -> DataFrame:
    """aligned with m (what the merge keeps; null: nothing) and conflict."""
    b, o, t = (F.col(x) for x in "bot")
    settled = o.eqNullSafe(t) | b.eqNullSafe(o) | b.eqNullSafe(t)
    merged = F.when(o.eqNullSafe(t), o).when(b.eqNullSafe(o), t).when(b.eqNullSafe(t), o).when(t.isNull(), o).otherwise(t)
    conflict = F.when(~settled, F.when(b.isNull(), "both added").when(o.isNull(), "delete/modify").when(t.isNull(), "modify/delete").otherwise("both modified"))
    return aligned.withColumn("m", merged).withColumn("conflict", conflict)


def blocked_files(entries: DataFrame, can_block: Column | None = None) -> DataFrame:
    """Keys of entries that other entries lie below: an equi semi-join on exploded ancestors."""
    above = entries.select(F.explode(strict_ancestors(F.col("key"))).alias("key")).distinct()
    return (entries.where(can_block) if can_block is not None else entries).join(above, "key", "left_semi").select("key")


def three_way_merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, value: str = "value", paths: bool = False, can_block: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(merged key/value, conflicts key, conflict, base, ours, theirs, conflict_rank).

    With paths=True a merged entry below which others lie is dropped and reported as file/directory; can_block tells which
    entries may collide (default all: any key).
    """
    done = classify(align(base, ours, theirs, value))
    kept = done.where(F.col("m").isNotNull())
    merged = kept.select("key", F.col(f"m.{value}").alias(value))
    fields = [F.col(f"{s}.{value}").alias(n) for s, n in (("b", "base"), ("o", "ours"), ("t", "theirs"))]
    conflicts = done.where(F.col("conflict").isNotNull()).select("key", "conflict", *fields, F.lit(0).alias("conflict_rank"))
    if paths:
        lost = blocked_files(merged, can_block)
        conflicts = conflicts.unionByName(done.join(lost, "key", "left_semi").select("key", F.lit("file/directory").alias("conflict"), *fields, F.lit(1).alias("conflict_rank")))
        merged = merged.join(lost, "key", "left_anti")
    return merged, conflicts


def conflict_markers(ours: Column, theirs: Column) -> Column:
    """Both contents between marker lines."""
    ended = lambda c: F.when(c.endswith("\n"), c).otherwise(F.concat(c, F.lit("\n")))
    return F.concat(F.lit("<<<<<<< ours\n"), ended(ours), F.lit("=======\n"), ended(theirs), F.lit(">>>>>>> theirs\n"))


def content_conflicts(conflicts: DataFrame, objects: DataFrame, ours: str = "ours", theirs: str = "theirs") -> DataFrame:
    """key, ours_text, theirs_text, marked of conflicts where both sides are content of `objects` (hash, bytes)."""
    both = conflicts.where(F.col("conflict").isin("both modified", "both added"))
    o, t = (objects.select(F.col("hash").alias(n), F.col("bytes").cast("string").alias(f"{n}_text")) for n in (ours, theirs))
    return both.join(o, ours).join(t, theirs).select("key", f"{ours}_text", f"{theirs}_text", conflict_markers(F.col(f"{ours}_text"), F.col(f"{theirs}_text")).alias("marked"))


def change_label(change: Column) -> Column:
    return F.when(change == "added", "+").when(change == "removed", "-").when(change == "modified", "~")
