"""Directory view of entries (key, kind, ...) with path-shaped keys. Paths are normalised; '' is the root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.functions.paths import below, strict_ancestors, under
from keyspan.functions.scalars import read_range
from keyspan.operators.snapshot import delete_many, put_many


class PathError(ValueError):
    """An operation that the tree's shape forbids."""


def exists(entries: DataFrame, path: str) -> DataFrame:
    """One row `found`: an entry at the path or below it; the root always is."""
    if path == "":
        return entries.sparkSession.range(1).select(F.lit(True).alias("found"))
    return entries.where(under(F.col("key"), path)).limit(1).agg((F.count("*") > 0).alias("found"))


def kind_of(entries: DataFrame, path: str) -> DataFrame:
    """One row `kind`: of the entry itself, else directory if anything lies below, else null."""
    if path == "":
        return entries.sparkSession.range(1).select(F.lit("directory").alias("kind"))
    hit = entries.where(under(F.col("key"), path))
    own = F.max(F.when(F.col("key") == path, F.col("kind")))
    return hit.agg(F.coalesce(own, F.when(F.count("*") > 0, "directory")).alias("kind"))


def is_dir(entries: DataFrame, path: str) -> DataFrame:
    return kind_of(entries, path).select((F.coalesce("kind", F.lit("")) == "directory").alias("found"))


def is_file(entries: DataFrame, path: str) -> DataFrame:
    return kind_of(entries, path).select((F.coalesce("kind", F.lit("")) == "file").alias("found"))


def is_symlink(entries: DataFrame, path: str) -> DataFrame:
    return kind_of(entries, path).select((F.coalesce("kind", F.lit("")) == "symlink").alias("found"))


def ls(entries: DataFrame, path: str = "") -> DataFrame:
    """name and kind, size, mode, mtime, target of the children; an entry of its own beats the directory its descendants imply."""
    rest = F.col("key") if path == "" else F.substring("key", len(path) + 2, 1 << 30)
    own = ~F.contains(rest, F.lit("/"))
    columns = [c for c in ("size", "mode", "mtime", "target") if c in entries.columns]
    child = F.struct(own.alias("own"), F.when(own, F.col("kind")).otherwise("directory").alias("kind"), *[F.when(own, F.col(c)).alias(c) for c in columns])
    rows = entries.where(below(F.col("key"), path)).select(F.substring_index(rest, "/", 1).alias("name"), child.alias("child"))
    return rows.groupBy("name").agg(F.max("child").alias("child")).select("name", "child.kind", *[f"child.{c}" for c in columns])


def tree(entries: DataFrame, path: str = "", depth: int | None = None) -> DataFrame:
    """path, depth, kind of everything below, directories implied by descendants included, down to a depth."""
    at = path.count("/") + 1 if path else 0
    inside = entries.where(below(F.col("key"), path))
    implied = inside.select(F.explode(strict_ancestors(F.col("key"))).alias("path")).where(below(F.col("path"), path)).select("path", F.struct(F.lit(False), F.lit("directory").alias("kind")).alias("x"))
    own = inside.select(F.col("key").alias("path"), F.struct(F.lit(True), F.col("kind").alias("kind")).alias("x"))
    level = F.size(F.split("path", "/")) - at
    found = own.unionByName(implied).groupBy("path").agg(F.max("x")["kind"].alias("kind")).select("path", level.alias("depth"), "kind")
    return found.where(F.col("depth") <= depth) if depth is not None else found


def dir_sizes(entries: DataFrame) -> DataFrame:
    """directory, children, files, bytes: direct children, and all files below with their bytes, for every directory."""
    placed = entries.select("key", "kind", "size", F.concat(F.array(F.lit("")), strict_ancestors(F.col("key"))).alias("above"))
    totals = placed.select("kind", "size", F.explode("above").alias("directory")).groupBy("directory").agg(F.count_if(F.col("kind") == "file").alias("files"), F.sum(F.when(F.col("kind") == "file", F.col("size")).otherwise(0)).alias("bytes"))
    parent = F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1)
    children = tree(entries).groupBy(parent.alias("directory")).agg(F.count("*").alias("children"))
    return totals.join(children, "directory").select("directory", "children", "files", "bytes")


def blocks(size: Column) -> Column:
    """512-byte blocks of a size."""
    return F.ceil(size / 512)


def violations(entries: DataFrame, new: DataFrame) -> DataFrame:
    """key, blocker: keys of new that would lie below a file or symlink."""
    above = new.select("key", F.explode(strict_ancestors(F.col("key"))).alias("blocker"))
    return above.join(entries.where(F.col("kind") != "directory").select(F.col("key").alias("blocker")), "blocker").select("key", "blocker")


def _refuse(bad: DataFrame, why: str) -> None:
    first = bad.limit(1).collect()
    if first:
        raise PathError(f"{why}: {first[0][0]!r}")


def write_files(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries with the new ones put in; none may lie below a file, nor take the place of a directory with entries."""
    _refuse(violations(entries, new), "a path above it is a file")
    above = entries.select(F.explode(strict_ancestors(F.col("key"))).alias("key")).distinct()
    _refuse(new.where(F.col("kind") != "directory").join(above, "key", "left_semi").select("key"), "a directory is there")
    return put_many(entries, new)


def mkdir(entries: DataFrame, path: str) -> DataFrame:
    """Entries with the directory; nothing changes if it is there."""
    kind = kind_of(entries, path).first()["kind"]
    if kind in ("file", "symlink"):
        raise PathError(f"not a directory: {path!r}")
    if kind == "directory":
        return entries
    row = entries.sparkSession.range(1).select(*[(F.lit(path) if c == "key" else F.lit("directory") if c == "kind" else F.lit(None)).cast(entries.schema[c].dataType).alias(c) for c in entries.columns])
    _refuse(violations(entries, row), "a path above it is a file")
    return entries.unionByName(row)


def rm(entries: DataFrame, path: str, recursive: bool = True) -> DataFrame:
    """Entries without the path and what lies below; a path that isn't there changes nothing."""
    if path == "":
        raise PathError("the root stays")
    if not recursive:
        if not entries.where(below(F.col("key"), path)).isEmpty():
            raise PathError(f"directory not empty: {path!r}")
    return entries.where(~under(F.col("key"), path))


def rebased(entries: DataFrame, source: str, target: str) -> DataFrame:
    """The entries at and below source under target's name."""
    moved = entries.where(under(F.col("key"), source))
    rest = F.col("key") if source == "" else F.substring("key", len(source) + 2, 1 << 30)
    return moved.withColumn("key", F.when(F.col("key") == source, target).otherwise(F.concat(F.lit(target + "/"), rest)))


def cp(entries: DataFrame, source: str, target: str, into: DataFrame | None = None) -> DataFrame:
    """`into` (default: entries) with target replaced by a copy of source and what lies below."""
    same = into is None
    into = entries if same else into
    if target == "" or same and (source == target or source == "" or target.startswith(source + "/")):
        raise PathError(f"can't copy {source!r} to {target!r}")
    if same and source.startswith(target + "/"):
        raise PathError(f"{target!r} holds {source!r}")
    copied = rebased(entries, source, target)
    if copied.isEmpty():
        raise PathError(f"not there: {source!r}")
    kept = into.where(~under(F.col("key"), target))
    _refuse(violations(kept, copied.where(F.col("key") == target).unionByName(copied.limit(1)).limit(1)), "a path above it is a file")
    return kept.unionByName(copied)


def mv(entries: DataFrame, source: str, target: str) -> DataFrame:
    return cp(entries, source, target).where(~under(F.col("key"), source))


def read_file(entries: DataFrame, objects: DataFrame, path: str) -> DataFrame:
    """One row path, status (ok, not found, is a directory, is a symlink, missing content), bytes."""
    own = entries.where(F.col("key") == path).select("key", "kind", "content_hash")
    found = own.join(objects.select(F.col("hash").alias("content_hash"), "bytes"), "content_hash", "left")
    one = found.agg(F.max(F.struct("kind", "bytes")).alias("x"))
    inside = kind_of(entries, path).select(F.col("kind").alias("implied"))
    status = F.when(F.col("x.kind") == "symlink", "is a symlink").when((F.col("x.kind") == "directory") | (F.col("implied") == "directory"), "is a directory").when(F.col("x").isNull(), "not found").when(F.col("x.bytes").isNull(), "missing content").otherwise("ok")
    joined = one.withColumn("_j", F.lit(1)).join(inside.withColumn("_j", F.lit(1)), "_j")  # one row each
    return joined.select(F.lit(path).alias("path"), status.alias("status"), F.when(status == "ok", F.col("x.bytes")).alias("bytes"))


def delete_paths(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """Entries without any of many paths (column key) and what lies below them: two equi-joins."""
    gone = entries.select("key", F.explode(strict_ancestors(F.col("key"))).alias("up")).join(paths.select(F.col("key").alias("up")), "up", "left_semi").select("key").distinct()
    return delete_many(delete_many(entries, paths), gone)


def read_file_range(entries: DataFrame, objects: DataFrame, path: str, offset: int, size: int) -> DataFrame:
    """read_file with the bytes from offset on, clamped to the end."""
    return read_file(entries, objects, path).withColumn("bytes", read_range(F.col("bytes"), F.lit(offset), F.lit(size)))


def read_symlink(entries: DataFrame, path: str) -> DataFrame:
    """One row path, target; links aren't followed, and anything else at the path is refused."""
    row = entries.where(F.col("key") == path).select("kind", "target").first()
    if row is None or row["kind"] != "symlink":
        raise PathError(f"not a symlink: {path!r}")
    return entries.sparkSession.createDataFrame([(path, row["target"])], "path string, target string")
