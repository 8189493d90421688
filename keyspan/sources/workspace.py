"""A working snapshot on a branch of a store: status, commit, checkout, merge, revert, and exchange with other stores.

The head names the current branch (`head/HEAD`), the working snapshot is a reference of its own (`working/HEAD`). Every step that
moves several references moves them together.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.operators import history, merge, setops
from keyspan.sources.store import MANIFEST, RefConflict, Store

HEAD, WORKING = "head/HEAD", "working/HEAD"


class WorkspaceError(RuntimeError):
    """A step that the state of the workspace doesn't allow."""


@dataclass(frozen=True)
class Merged:
    """Outcome of a merge: up to date, fast-forward, merged, or conflicts (then without a commit)."""

    outcome: str
    commit: str | None
    conflicts: DataFrame | None = None


class Workspace:
    def __init__(self, store: Store, author: str = "user", clock: Callable[[], float] = time.time):
        self.store, self.author, self.clock = store, author, clock

    def branch(self) -> str | None:
        """The current branch; main before any other was checked out, none if the head is a commit."""
        head = self.store.refs().get(HEAD, "main")
        return None if len(head) == 64 else head

    def _branch(self) -> str:
        name = self.branch()
        if name is None:
            raise WorkspaceError("the head is detached: check out a branch first")
        return name

    def head(self) -> str | None:
        """The commit that the head stands on."""
        refs = self.store.refs()
        head = refs.get(HEAD, "main")
        return head if len(head) == 64 else refs.get(f"branch/{head}")

    def head_tree(self) -> str | None:
        tip = self.head()
        return self.store.tree(tip) if tip else None

    def working_tree(self) -> str | None:
        return self.store.refs().get(WORKING) or self.head_tree()

    def working(self) -> DataFrame:
        tree = self.working_tree()
        return self.store.snapshot(tree).select("key", "value") if tree else self.store.spark.createDataFrame([], "key string, value string")

    def _move(self, changes: dict[str, str | None]) -> None:
        refs = self.store.refs()
        self.store.set_refs({k: (v, refs.get(k)) for k, v in changes.items()})

    def change(self, changes: DataFrame) -> str:
        """Applies changes (key, value; null value: delete) to the working snapshot."""
        name = self.store.apply(self.working_tree(), changes)
        self._move({WORKING: name})
        return name

    def status(self) -> DataFrame:
        """setops.diff of the head's snapshot and the working one."""
        old, new = self.head_tree(), self.working_tree()
        if old and new:
            return self.store.diff(old, new)
        return setops.diff(self.working().limit(0), self.working())

    def _committed(self, tree: str, parents: list[str], message: str) -> str:
        commit = self.store.commit(tree, parents, self.author, message, int(self.clock()))
        self._move({f"branch/{self._branch()}": commit, WORKING: tree})
        return commit

    def commit(self, message: str) -> str | None:
        """The new commit of the working snapshot, or none if there is nothing to commit."""
        tip, work = self.head(), self.working_tree()
        if work is None or work == self.head_tree():
            return None
        return self._committed(work, [tip] if tip else [], message)

    def log(self) -> DataFrame | None:
        tip = self.head()
        return history.log(self.store.commits(), tip) if tip else None

    def resolve(self, spec: str) -> str:
        return history.resolve(self.store.commits(), self.store.refs_frame(), spec, self.head())

    def make_branch(self, name: str, start: str | None = None) -> str:
        at = self.resolve(start) if start else self.head()
        if not at:
            raise WorkspaceError("no commit to branch from")
        self.store.set_ref("branch", name, at)
        return at

    def checkout(self, branch: str, force: bool = False) -> bool:
        """Whether the branch changed. Uncommitted changes are in the way unless force."""
        if branch == self.branch():
            return False
        tip = self.store.refs().get(f"branch/{branch}")
        if not force and self.working_tree() != self.head_tree():
            raise WorkspaceError("the working snapshot has changes")
        if tip is None:
            raise WorkspaceError(f"no branch {branch!r}")
        self._move({HEAD: branch, WORKING: self.store.tree(tip)})
        return True

    def merge(self, branch: str) -> Merged:
        """Merges a branch into the current one. On conflicts the working snapshot holds the merge, contents that both sides changed between marker lines, and nothing is committed."""
        ours, theirs = self.head(), self.store.refs().get(f"branch/{branch}")
        if ours is None:
            raise WorkspaceError("no commit to merge into")
        if theirs is None:
            raise WorkspaceError(f"no branch {branch!r}")
        if ours == theirs:
            return Merged("up to date", ours)
        commits, current = self.store.commits(), self._branch()
        base = next((r["hash"] for r in history.merge_base(commits, ours, theirs).collect()), None)
        if base == ours:
            self._move({f"branch/{current}": theirs, WORKING: self.store.tree(theirs)})
            return Merged("fast-forward", theirs)
        sides = [self.store.snapshot(self.store.tree(c)).select("key", "value") if c else None for c in (base, ours, theirs)]
        sides[0] = sides[0] if base else sides[1].limit(0)
        merged, conflicts = merge.three_way_merge(*sides, paths=True)
        both = conflicts.where(F.col("conflict").isin("both modified", "both added")).select("key", merge.conflict_markers(F.col("ours"), F.col("theirs")).alias("marked"))
        marked = merged.join(both, "key", "left").select("key", F.coalesce("marked", "value").alias("value"))
        tree = self.store.write_snapshot(marked)
        if not conflicts.isEmpty():
            self._move({WORKING: tree})
            return Merged("conflicts", None, conflicts)
        return Merged("merged", self._committed(tree, [ours, theirs], f"merge {branch} into {current}"))

    def abort(self) -> None:
        """The working snapshot is the head's again."""
        self._move({WORKING: self.head_tree()})

    def revert(self, spec: str) -> str | None:
        """Commits the snapshot of an older commit on top of the current one; none if it is the same."""
        tip = self.head()
        if tip is None:
            raise WorkspaceError("nothing to revert")
        target = self.resolve(spec)
        tree = self.store.tree(target)
        return None if tree == self.store.tree(tip) else self._committed(tree, [tip], f"revert to {spec} ({target[:12]})")


def send(source: Store, target: Store, commit: str) -> int:
    """Copies the commits that a commit reaches, and the buckets of their snapshots, as far as the target lacks them; the number of commits and buckets copied."""
    spark, commits = source.spark, source.commits()
    reached = commits.join(history.ancestors(commits, commit).select("hash"), "hash", "left_semi")
    new = reached.join(target.commits().select("hash"), "hash", "left_anti")
    trees = [r["tree"] for r in new.select("tree").distinct().collect() if not target._has("snapshots", r["tree"], "_SUCCESS")]
    manifests = {t: [tuple(r) for r in source.manifest(t).collect()] for t in trees}
    wanted = sorted({(m[4], m[0]) for rows in manifests.values() for m in rows if not target._has("buckets", f"id={m[4]}", f"bucket={m[0]}")})
    if wanted:
        paths = [f"{source.root}/buckets/id={home}/bucket={b}" for home, b in wanted]
        name = f"incoming-{commit[:12]}"
        spark.read.option("basePath", f"{source.root}/buckets").parquet(*paths).write.mode("overwrite").partitionBy("id", "bucket").parquet(f"{target.root}/{name}")
        fs = target._fs()
        for home, b in wanted:  # a bucket appears whole or not at all
            fs.mkdirs(target._path("buckets", f"id={home}"))
            fs.rename(target._path(name, f"id={home}", f"bucket={b}"), target._path("buckets", f"id={home}", f"bucket={b}"))
        fs.delete(target._path(name), True)
    for t, rows in manifests.items():
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{target.root}/snapshots/{t}")
    missing = new.collect()  # commit records, which are small
    if missing:
        spark.createDataFrame(missing, new.schema).coalesce(1).write.mode("append").parquet(f"{target.root}/commits")
    return len(wanted) + len(missing)


def fetch(local: Store, remote: Store, branch: str, as_branch: str | None = None) -> int:
    """Brings a remote branch here under its name or another; what the local branch was doesn't matter."""
    tip = remote.refs().get(f"branch/{branch}")
    if tip is None:
        raise WorkspaceError(f"no branch {branch!r} there")
    n = send(remote, local, tip)
    local.set_ref("branch", as_branch or branch, tip, force=True)
    return n


def push(local: Store, remote: Store, branch: str, as_branch: str | None = None, force: bool = False) -> int:
    """Sends a branch; the remote branch moves forward only, unless force."""
    tip = local.refs().get(f"branch/{branch}")
    if tip is None:
        raise WorkspaceError(f"no branch {branch!r}")
    name = as_branch or branch
    there = remote.refs().get(f"branch/{name}")
    if there and there != tip and not force:
        commits = local.commits()
        if commits.where(F.col("hash") == there).isEmpty() or not history.is_ancestor(commits, there, tip):
            raise RefConflict(f"{name} there isn't an ancestor of {branch}")
    n = send(local, remote, tip)
    if there != tip:
        remote.set_ref("branch", name, tip, expected=there, force=force)
    return n
