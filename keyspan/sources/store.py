"""A store on disk: objects by address, snapshots by bucket with digests, commits, and references.

    <root>/objects/shard=ab/…          objects, partitioned by the first two digits of their address
    <root>/quarantine/…                objects that didn't have their address
    <root>/buckets/id=…/bucket=n/…     entries sorted by key
    <root>/snapshots/<name>/…          a row per bucket: rows, digest and the id that holds its entries
    <root>/commits/…                   appended commits
    <root>/refs/refs-<version>.json    references; small, the highest version counts

Tables are written and read by Spark and may lie in any file system that Spark reaches. A snapshot is there once its last write
is complete; one that broke off is written again. A new version of the references is renamed into place while the one
before stays, so that a reader or a crash never finds none; writers exclude each other by a lock file with owner and time, which
another writer may break when it is old.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.operators import setops
from keyspan.operators.snapshot import delete_many, put_many
from keyspan.plans.digests import bucket, bucket_digests, buckets_for, changed_buckets, folded
from keyspan.schema import COMMIT, content_hash

OBJECTS = "hash string, kind string, bytes binary, shard string"
MANIFEST = "bucket int, rows long, digest string, n int, home string"


class RefConflict(RuntimeError):
    """A reference isn't what the writer expected, or another writer is at work."""


class Store:
    def __init__(self, spark: SparkSession, root: str, lock_seconds: float = 60.0):
        self.spark, self.root, self.lock_seconds = spark, root.rstrip("/"), lock_seconds

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _has(self, *parts: str) -> bool:
        return self._fs().exists(self._path(*parts))

    def _names(self, *parts: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs().listStatus(self._path(*parts))] if self._has(*parts) else []

    # objects

    def objects(self) -> DataFrame:
        if not self._has("objects"):
            return self.spark.createDataFrame([], OBJECTS)
        return self.spark.read.schema(OBJECTS).parquet(f"{self.root}/objects")

    def put(self, contents: DataFrame, content: str = "bytes", kind: str = "blob") -> DataFrame:
        """Appends contents that aren't there yet; returns hash and the input's columns."""
        named = contents.withColumn("hash", content_hash(F.col(content)))
        new = named.groupBy("hash").agg(F.first(F.col(content).cast("binary")).alias("bytes")).join(self.objects().select("hash"), "hash", "left_anti")
        new.select("hash", F.lit(kind).alias("kind"), "bytes", F.substring("hash", 1, 2).alias("shard")).write.mode("append").partitionBy("shard").parquet(f"{self.root}/objects")
        return named

    def find(self, prefix: str) -> DataFrame:
        """Objects by a hex prefix; two digits or more open one shard only."""
        p = prefix.lower()
        if any(c not in "0123456789abcdef" for c in p):
            return self.objects().limit(0)
        found = self.objects().where(F.col("hash").startswith(p)) if p else self.objects()
        return found.where(F.col("shard") == p[:2]) if len(p) >= 2 else found

    def intact(self) -> DataFrame:
        """Objects whose bytes have their address; others count as missing."""
        return self.objects().where(content_hash(F.col("bytes")) == F.col("hash"))

    def read(self, wanted: DataFrame) -> DataFrame:
        """hash, status (ok, corrupt, missing), bytes of the wanted hashes; bytes only where they have their address."""
        found = wanted.select("hash").distinct().join(self.objects().select("hash", "bytes").dropDuplicates(["hash"]), "hash", "left")
        status = F.when(F.col("bytes").isNull(), "missing").when(content_hash(F.col("bytes")) == F.col("hash"), "ok").otherwise("corrupt")
        return found.withColumn("status", status).select("hash", "status", F.when(F.col("status") == "ok", F.col("bytes")).alias("bytes"))

    def quarantine(self) -> int:
        """Moves objects that don't have their address out of the way, so that a put stores them anew; their number."""
        bad = self.objects().where(content_hash(F.col("bytes")) != F.col("hash")).select("hash", "kind", "bytes")
        at = f"{self.root}/quarantine/{uuid.uuid4().hex}"
        bad.write.parquet(at)
        moved = self.spark.read.schema("hash string, kind string, bytes binary").parquet(at)
        n = moved.count()
        if n:
            self.delete(moved.select("hash"))
        return n

    def delete(self, gone: DataFrame) -> None:
        """Rewrites the shards of the objects to delete, and only those: what stays is written before the old files go, so that a crash can leave rows twice but loses none; the next delete in the shard mends that."""
        shards = [r[0] for r in gone.select(F.substring("hash", 1, 2)).distinct().collect()]  # at most 256
        shards = [s for s in shards if self._has("objects", f"shard={s}")]
        if not shards:
            return
        old = [self._path("objects", f"shard={s}", name) for s in shards for name in self._names("objects", f"shard={s}")]
        kept = self.objects().where(F.col("shard").isin(shards)).join(gone.select("hash"), "hash", "left_anti").dropDuplicates(["hash"])
        kept.write.mode("append").partitionBy("shard").parquet(f"{self.root}/objects")
        for path in old:
            self._fs().delete(path, False)
        self.spark.catalog.refreshByPath(f"{self.root}/objects")

    # snapshots

    def write_snapshot(self, snapshot: DataFrame, n: int | None = None) -> str:
        """Stores (key, value) by bucket, keys sorted, and the digests; returns the digest of digests. An equal snapshot isn't written twice."""
        n = n or buckets_for(snapshot.count())
        rows = sorted(map(tuple, bucket_digests(snapshot, n).collect()))  # at most n
        return self._stored(snapshot, rows, n, [])

    def apply(self, name: str | None, changes: DataFrame) -> str:
        """The snapshot after changes (key, value; null value: delete), one a key; only the buckets they touch are read and written."""
        if name is None:
            return self.write_snapshot(changes.where("value IS NOT NULL"))
        manifest = [tuple(r) for r in self.manifest(name).collect()]  # a row per bucket
        n = manifest[0][3] if manifest else buckets_for(0)
        touched = [r[0] for r in changes.select(bucket(F.col("key"), n)).distinct().collect()]
        now = self.snapshot(name).where(F.col("bucket").isin(touched)).select("key", "value")
        after = delete_many(put_many(now, changes.where("value IS NOT NULL")), changes.where("value IS NULL"))
        rows = sorted(map(tuple, bucket_digests(after, n).collect()))
        return self._stored(after, rows, n, [m for m in manifest if m[0] not in set(touched)])

    def _stored(self, entries: DataFrame, rows: list[tuple], n: int, others: list[tuple]) -> str:
        """Writes the entries' buckets and the manifest of these and the others."""
        every = sorted([*rows, *[m[:3] for m in others]])
        name = self.spark.createDataFrame([(json.dumps([n, *every], default=str),)], "x string").select(F.sha2("x", 256)).first()[0]
        if not self._has("snapshots", name, "_SUCCESS"):
            home = uuid.uuid4().hex
            if rows:
                parts = min(n, 4 * len(rows), 2048)
                entries.withColumn("bucket", bucket(F.col("key"), n)).repartition(parts, "bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(f"{self.root}/buckets/id={home}")
            found = [(*r, n, home) for r in rows] + others
            self.spark.createDataFrame(found, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/snapshots/{name}")
        return name

    def manifest(self, name: str) -> DataFrame:
        if not self._has("snapshots", name, "_SUCCESS"):
            raise FileNotFoundError(f"{self.root}/snapshots/{name}")
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/snapshots/{name}")

    def snapshot(self, name: str, buckets: list[int] | None = None, divided: int | None = None) -> DataFrame:
        """key, value, bucket of a stored snapshot, or of those of its buckets that fall into the given ones of a division."""
        rows = [r for r in self.manifest(name).collect() if buckets is None or r["bucket"] % (divided or r["n"]) in set(buckets)]
        if not rows:
            return self.spark.createDataFrame([], "key string, value string, bucket int")
        paths = [f"{self.root}/buckets/id={r['home']}/bucket={r['bucket']}" for r in rows]
        return self.spark.read.option("basePath", f"{self.root}/buckets").parquet(*paths).select("key", "value", "bucket")

    def digests(self, name: str) -> DataFrame:
        return self.manifest(name).select("bucket", "rows", "digest")

    def count(self, name: str) -> int:
        """Entries of a stored snapshot, from its digests alone."""
        return self.digests(name).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def diff(self, old: str, new: str) -> DataFrame:
        """setops.diff of two stored snapshots; equal ones aren't read, of others only the buckets that differ."""
        if old == new:
            empty = self.snapshot(old, []).select("key", "value")
            return setops.diff(empty, empty)
        sizes = [r[0] for s in (old, new) if (r := self.manifest(s).agg(F.min("n")).first())[0]]
        n = min(sizes) if sizes else buckets_for(0)
        changed = changed_buckets(folded(self.digests(old), n), folded(self.digests(new), n))
        return setops.diff(*[self.snapshot(s, changed, n).select("key", "value") for s in (old, new)])

    # commits and references

    def commits(self) -> DataFrame:
        return self.spark.read.schema(COMMIT).parquet(f"{self.root}/commits") if self._has("commits") else self.spark.createDataFrame([], COMMIT)

    def commit(self, tree: str, parents: list[str], author: str, message: str, ts: int) -> str:
        text = json.dumps([tree, parents, author, message, ts])
        name = self.spark.createDataFrame([(text,)], "x string").select(F.sha2("x", 256)).first()[0]
        row = self.spark.createDataFrame([(name, parents, tree, author, message, ts)], COMMIT)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        return name

    def tree(self, commit: str) -> str:
        found = self.commits().where(F.col("hash") == commit).first()
        if found is None:
            raise FileNotFoundError(f"commit {commit}")
        return found["tree"]

    def _versions(self) -> list[int]:
        names = self._names("refs")
        return sorted(int(x[5:-5]) for x in names if x.startswith("refs-") and x.endswith(".json"))

    def _text(self, *parts: str) -> str:
        stream = self._fs().open(self._path(*parts))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, text: str, *parts: str) -> None:
        out = self._fs().create(self._path(*parts), True)
        out.write(bytearray(text.encode()))
        out.close()

    def refs(self) -> dict[str, str]:
        """'kind/name' to commit, or to the name of a branch for the head."""
        versions = self._versions()
        return json.loads(self._text("refs", f"refs-{versions[-1]:020d}.json")) if versions else {}

    def _locked(self) -> str:
        """The owner under which this writer holds the lock."""
        fs, lock, owner = self._fs(), self._path("refs", "lock"), uuid.uuid4().hex
        fs.mkdirs(self._path("refs"))
        if not fs.createNewFile(lock):
            try:
                age = time.time() - fs.getFileStatus(lock).getModificationTime() / 1000
            except Exception:  # noqa: BLE001 - it was released meanwhile
                age = self.lock_seconds + 1
            broken = self._path("refs", f"broken-{owner}")
            if age <= self.lock_seconds or fs.exists(lock) and not fs.rename(lock, broken):
                raise RefConflict("another writer holds the references")
            fs.delete(broken, False)
            if not fs.createNewFile(lock):
                raise RefConflict("another writer holds the references")
        self._write(owner, "refs", "lock")
        return owner

    def set_refs(self, changes: dict[str, tuple[str | None, str | None]], force: bool = False) -> None:
        """Moves, makes or (new None) removes references, all or none: 'kind/name' to (new, expected). Tags don't move."""
        owner = self._locked()
        try:
            refs, versions = self.refs(), self._versions()
            for key, (new, expected) in changes.items():
                if not force and (refs.get(key) != expected or key.startswith("tag/") and key in refs and new is not None):
                    raise RefConflict(f"{key} is {refs.get(key)}, not {expected}")
                refs.pop(key, None)
                if new is not None:
                    refs[key] = new
            fresh = f"fresh-{owner}"
            self._write(json.dumps(refs, sort_keys=True), "refs", fresh)
            if self._text("refs", "lock") != owner:
                raise RefConflict("the lock was broken by another writer")
            at = (versions[-1] if versions else 0) + 1
            if not self._fs().rename(self._path("refs", fresh), self._path("refs", f"refs-{at:020d}.json")):
                raise RefConflict("another writer was first")
            for v in versions[:-8]:
                self._fs().delete(self._path("refs", f"refs-{v:020d}.json"), False)
        finally:
            if self._has("refs", "lock") and self._text("refs", "lock") == owner:
                self._fs().delete(self._path("refs", "lock"), False)

    def set_ref(self, kind: str, name: str, new: str | None, expected: str | None = None, force: bool = False) -> None:
        """set_refs of one reference."""
        self.set_refs({f"{kind}/{name}": (new, expected)}, force)

    def refs_frame(self, container: str = "main") -> DataFrame:
        rows = [(container, *k.split("/", 1), v) for k, v in sorted(self.refs().items())]
        return self.spark.createDataFrame(rows, "container string, kind string, name string, commit string")
