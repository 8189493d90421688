"""Commit graphs: commits(hash, parents array<string>, ts, ...)."""

from __future__ import annotations

from array import array
from collections import deque
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.plans.scratch import numbered, written

#: Graphs of up to this many commits are walked on the driver (hash and parents only).
DRIVER_COMMITS = 200_000
#: Graphs of up to this many commits, and twice as many parents, are walked there by number, as Spark would need jobs for each level;
#: larger ones level by level in Spark. All find the same commits in the same order.
NUMBERED_COMMITS = 20_000_000
#: Rows that pass between Spark and the driver at a time: tasks carry them, and the driver's heap holds several copies of these.
BLOCK = 500_000
RANKED = "hash string, depth int, rank long"


class HistoryError(ValueError):
    """A commit or reference that can't be resolved."""


def _walked(parents: dict[str, list[str]], starts: list[str]) -> list[tuple[str, int, int]]:
    """(hash, depth, rank) of what the starts reach, breadth first."""
    seen, queue, out = set(starts), deque((s, 0) for s in dict.fromkeys(starts)), []
    while queue:
        h, d = queue.popleft()
        if h not in parents:
            raise HistoryError(f"missing commit {h}")
        out.append((h, d, len(out)))
        for p in parents[h] or ():
            if p not in seen:
                seen.add(p)
                queue.append((p, d + 1))
    return out


def _walks(commits: DataFrame, every: list[list[str]], driver_commits: int, numbered_commits: int) -> list[DataFrame]:
    """hash, depth, rank of what each list of starts reaches; the graph is read once."""
    spark, slim = commits.sparkSession, commits.select("hash", "parents")
    read = slim.limit(driver_commits + 1).collect()
    if len(read) > driver_commits:
        del read
        held = written(slim)
        if held.count() <= numbered_commits and held.agg(F.sum(F.greatest(F.size("parents"), F.lit(0)))).first()[0] <= 2 * numbered_commits:
            return _by_number(held, every)
        return [_by_level(held, starts) for starts in every]
    parents = {r["hash"]: r["parents"] for r in read}
    return [spark.createDataFrame(_walked(parents, starts), RANKED) for starts in every]


def _flat(edges: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """first, to of edges (child, pos, to): the parents of commit i, in order, are to[first[i]:first[i + 1]]."""
    size = edges.count()
    first, to, at, step = np.zeros(n + 1, np.int64), np.empty(size, np.int32), 0, max(1, n * BLOCK // max(size, 1))
    for low in range(0, n, step):
        part = edges.where((F.col("child") >= low) & (F.col("child") < low + step)).toArrow()
        child, pos, up = (part[c].to_numpy() for c in ("child", "pos", "to"))
        first[low + 1:low + step + 1] = np.bincount(child - low, minlength=min(step, n - low))
        to[at:at + len(up)] = up[np.lexsort((pos, child))]
        at += len(up)
    return np.cumsum(first, out=first), to


def _walked_numbers(first: np.ndarray, to: np.ndarray, starts: list[int]) -> tuple[array, array, int]:
    """The commits that the starts reach, breadth first, and their depths; the last is a commit with a missing parent, or -1."""
    seen, order, depth = bytearray(len(first) - 1), array("i", starts), array("i", [0] * len(starts))
    first, to = memoryview(first), memoryview(to)
    for s in starts:
        seen[s] = 1
    for at, h in enumerate(order):  # grows
        for i in range(first[h], first[h + 1]):
            p = to[i]
            if p < 0:
                return order, depth, h
            if not seen[p]:
                seen[p] = 1
                order.append(p)
                depth.append(depth[at] + 1)
    return order, depth, -1


def _by_number(slim: DataFrame, every: list[list[str]]) -> list[DataFrame]:
    """The walk on the driver with numbers for hashes, in flat arrays of about 25 bytes a commit."""
    spark = slim.sparkSession
    names = numbered(slim.select("hash").distinct(), [F.col("hash")], "id")
    edges = slim.select("hash", F.posexplode("parents").alias("pos", "parent")).join(names.withColumnRenamed("id", "child"), "hash").join(names.select(F.col("hash").alias("parent"), F.col("id").alias("to")), "parent", "left")
    first, to = _flat(written(edges.select(F.col("child").cast("int"), "pos", F.coalesce("to", F.lit(-1)).cast("int").alias("to"))), names.count())
    out = []
    for starts in every:
        unique = list(dict.fromkeys(starts))
        ids = {r["hash"]: r["id"] for r in names.join(spark.createDataFrame([(s,) for s in unique], "hash string"), "hash").collect()}
        lost = [s for s in unique if s not in ids]
        if not lost:
            order, depth, at = _walked_numbers(first, to, [ids[s] for s in unique])
            if at >= 0:
                lost = [slim.join(names.where(F.col("id") == at), "hash").select(F.explode("parents").alias("hash")).join(names, "hash", "left_anti").first()["hash"]]
        if lost:
            raise HistoryError(f"missing commit {lost[0]}")
        parts = []
        for low in range(0, len(order), BLOCK):
            part = np.asarray(order[low:low + BLOCK], np.int32)
            parts.append(written(spark.createDataFrame(pa.table({"id": part, "depth": np.asarray(depth[low:low + BLOCK], np.int32), "rank": np.arange(low, low + len(part), dtype=np.int32)}))))
        walk = reduce(DataFrame.unionByName, parts, spark.createDataFrame([], "id int, depth int, rank int")).select(F.col("id").cast("long"), "depth", F.col("rank").cast("long"))
        out.append(names.join(walk, "id").select("hash", "depth", "rank"))
    return out


def ancestors(commits: DataFrame, start: str | list[str], driver_commits: int = DRIVER_COMMITS, numbered_commits: int = NUMBERED_COMMITS) -> DataFrame:
    """hash, depth, rank of all commits that the starts reach, themselves included; rank is the order of discovery: by level, then by the rank of the discovering commit and its order of parents."""
    return _walks(commits, [[start] if isinstance(start, str) else list(start)], driver_commits, numbered_commits)[0]


def _by_level(slim: DataFrame, starts: list[str]) -> DataFrame:
    """The walk in Spark."""
    spark, depth = slim.sparkSession, 0
    unique = list(dict.fromkeys(starts))
    front = known = written(spark.createDataFrame([(s, 0, i) for i, s in enumerate(unique)], RANKED))
    found = len(unique)
    while True:
        depth += 1
        steps = slim.join(front.select("hash", "rank"), "hash").select("rank", F.posexplode("parents").alias("pos", "hash"))
        new = steps.groupBy("hash").agg(F.min(F.struct("rank", "pos")).alias("by")).join(known.select("hash"), "hash", "left_anti")
        front = written(numbered(new, [F.col("by.rank"), F.col("by.pos")], "rank", found).select("hash", F.lit(depth).alias("depth"), "rank"))
        size = front.count()
        if not size:
            break
        found += size
        known = known.unionByName(front) if depth % 16 else written(known.unionByName(front))
    lost = known.join(slim, "hash", "left_anti").limit(1).collect()
    if lost:
        raise HistoryError(f"missing commit {lost[0]['hash']}")
    return known


def log(commits: DataFrame, start: str, driver_commits: int = DRIVER_COMMITS, numbered_commits: int = NUMBERED_COMMITS) -> DataFrame:
    """The commits from start back with `position`, newest first; equal times in order of discovery."""
    found = commits.join(ancestors(commits, start, driver_commits, numbered_commits), "hash")
    return numbered(found, [F.desc("ts"), F.col("rank")], "position").orderBy("position")


def merge_base(commits: DataFrame, a: str, b: str, driver_commits: int = DRIVER_COMMITS, numbered_commits: int = NUMBERED_COMMITS) -> DataFrame:
    """hash, ts of the best common ancestor: none of the others descends from it; of several the latest, then the largest hash. Empty if disjoint."""
    left, right = _walks(commits, [[a], [b]], driver_commits, numbered_commits)
    common = left.select("hash").join(right.select("hash"), "hash", "left_semi")
    meta = commits.join(common, "hash", "left_semi")
    # a common ancestor is a proper ancestor of another common one iff it is a parent of a common one: the set is closed upwards
    covered = meta.select(F.explode("parents").alias("hash")).distinct()
    lowest = meta.join(covered, "hash", "left_anti")
    best = lowest.agg(F.max(F.struct("ts", "hash")).alias("x")).where("x IS NOT NULL")
    return best.select("x.hash", "x.ts")


def is_ancestor(commits: DataFrame, old: str, new: str) -> bool:
    """Whether moving a reference from old to new is a fast-forward."""
    return not ancestors(commits, new).where(F.col("hash") == old).isEmpty()


def resolve(commits: DataFrame, refs: DataFrame, spec: str, head: str | None = None) -> str:
    """Commit of HEAD, a full hash, a branch, a tag, or a unique hex prefix of at least six digits, in this order."""
    if spec.upper() == "HEAD" and head:
        return resolve(commits, refs, head)
    wanted = [commits.where(F.col("hash") == spec.lower()).select(F.lit(0).alias("rank"), "hash")] if len(spec) == 64 else []
    wanted += [refs.where((F.col("kind") == kind) & (F.col("name") == spec)).select(F.lit(rank).alias("rank"), F.col("commit").alias("hash")) for rank, kind in ((1, "branch"), (2, "tag"))]
    if len(spec) >= 6 and all(c in "0123456789abcdefABCDEF" for c in spec):
        wanted.append(commits.where(F.col("hash").startswith(spec.lower())).select(F.lit(3).alias("rank"), "hash").limit(2))
    every = wanted[0]
    for w in wanted[1:]:
        every = every.unionByName(w)
    found = sorted((r["rank"], r["hash"]) for r in every.limit(8).collect())
    best = {h for rank, h in found if rank == found[0][0]} if found else set()
    if not best:
        raise HistoryError(f"unknown reference {spec!r}")
    if len(best) > 1:
        raise HistoryError(f"ambiguous reference {spec!r}")
    return best.pop()


def reachable(commits: DataFrame, starts: list[str], tree_objects: DataFrame) -> DataFrame:
    """hash, kind of everything the starts keep: commits, and the objects of their trees (tree, hash, kind)."""
    closure = ancestors(commits, starts).select("hash")
    trees = commits.join(closure, "hash", "left_semi").select("tree").distinct()
    held = tree_objects.join(trees, "tree", "left_semi").select("hash", "kind")
    return closure.withColumn("kind", F.lit("commit")).unionByName(held).distinct()
