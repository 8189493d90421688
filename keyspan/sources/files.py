"""Files, archives and small records as DataFrames."""

from __future__ import annotations

import gzip
import io
import os
import posixpath
import re
import tarfile
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.functions.paths import normalize_path
from keyspan.functions.scalars import compression
from keyspan.operators.config import ConfigError
from keyspan.schema import PEER, content_hash

MEMBERS = "path string, kind string, mode int, mtime long, link_target string, bytes binary"


LISTED = "path string, kind string, size long, mtime long, target string"


def _file_system(where: str):
    """The Arrow file system of a folder that driver and executors share, and the folder's path in it."""
    from pyarrow import fs

    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", where) and not where.startswith("file:"):
        return fs.FileSystem.from_uri(where)
    plain = re.sub(r"^file:(//)?", "", where)
    return fs.LocalFileSystem(), os.path.abspath(plain)


def _children(where: str, below: str, deep: bool) -> list[tuple[str, str, int, int, str | None]]:
    """(path below the folder, kind, size, mtime, target) of what lies in a directory of it, links not followed."""
    from pyarrow import fs

    system, root = _file_system(where)
    root = root.rstrip("/")
    at = posixpath.join(root, below) if below else root
    local = isinstance(system, fs.LocalFileSystem)
    out, todo = [], [at]
    while todo:
        for info in system.get_file_info(fs.FileSelector(todo.pop())):
            path, link = info.path[len(root) + 1 :], local and os.path.islink(info.path)
            if link:
                out.append((path, "symlink", 0, int(os.lstat(info.path).st_mtime), os.readlink(info.path)))
            elif info.type == fs.FileType.Directory:
                out.append((path, "directory", 0, 0, None))
                if deep:
                    todo.append(info.path)
            else:
                out.append((path, "file", info.size, (info.mtime_ns or 0) // 1_000_000_000, None))
    return out


def list_directory(spark: SparkSession, where: str) -> DataFrame:
    """LISTED of everything below a folder, empty files and links included: the driver lists the first level, executors what lies below."""
    top = _children(where, "", False)
    rows = spark.createDataFrame(top, LISTED)
    names = [r[0] for r in top if r[1] == "directory"]
    if not names:
        return rows

    def deeper(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["path"]:
                yield pd.DataFrame(_children(where, name, True), columns=["path", "kind", "size", "mtime", "target"])

    folders = spark.createDataFrame([(n,) for n in names], "path string").repartition(min(len(names), 1000))
    return rows.unionByName(folders.mapInPandas(deeper, LISTED))


def read_directory(spark: SparkSession, where: str) -> DataFrame:
    """key, kind, size, mtime, target, content_hash, bytes of all files and symlinks below a folder; directories are implied."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _file_system(where)
        for batch in batches:
            for r in batch.itertuples():  # one file at a time
                content = None
                if r.kind == "file":
                    with system.open_input_stream(posixpath.join(root, r.path)) as f:
                        content = f.read()
                yield pd.DataFrame({"path": [r.path], "kind": [r.kind], "size": [r.size], "mtime": [r.mtime], "target": [r.target], "bytes": [content]})

    held = list_directory(spark, where).where("kind <> 'directory'")
    loaded = held.mapInPandas(load, f"{LISTED}, bytes binary")
    return loaded.select(normalize_path(F.col("path")).alias("key"), "kind", "size", "mtime", "target", F.when(F.col("kind") == "file", content_hash(F.col("bytes"))).alias("content_hash"), "bytes")


def write_directory(files: DataFrame, where: str, overwrite: bool = False) -> int:
    """Writes key and bytes (and, on a local file system, symlinks with their target) below a folder from the executors; the number written. Without overwrite nothing may be there."""
    kinds = ["file", "symlink"] if "target" in files.columns else ["file"]
    rows = files.where(F.col("kind").isin(kinds)).select("key", "kind", "bytes", (F.col("target") if "target" in files.columns else F.lit(None).cast("string")).alias("target"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = _file_system(where)
        local = isinstance(system, fs.LocalFileSystem)
        for batch in batches:
            for r in batch.itertuples():
                at = posixpath.join(root, r.key)
                there = system.get_file_info(at).type != fs.FileType.NotFound or local and os.path.islink(at)
                if there and not overwrite:
                    yield pd.DataFrame({"taken": [r.key], "n": [0]})
                    continue
                system.create_dir(posixpath.dirname(at), recursive=True)
                if r.kind == "symlink":
                    if not local:
                        raise NotImplementedError(f"no symlinks in {where}")
                    if there:
                        os.remove(at)
                    os.symlink(r.target, at)
                else:
                    with system.open_output_stream(at) as f:
                        f.write(r.bytes)
                yield pd.DataFrame({"taken": [None], "n": [1]})

    done = rows.mapInPandas(write, "taken string, n long").agg(F.sum("n").alias("n"), F.min("taken").alias("taken")).first()
    if done["taken"] is not None:
        raise FileExistsError(done["taken"])
    return done["n"] or 0


def unpacked(content: bytes) -> bytes:
    """Content of a gzip or zstd stream, or as it is, by its first bytes."""
    if content[:2] == b"\x1f\x8b":
        return gzip.decompress(content)
    if content[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(content)
    return content


def read_layers(archives: DataFrame) -> DataFrame:
    """Members of archives (layer, bytes) in order: layer, ord and MEMBERS; devices and pipes are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for layer, content in zip(batch["layer"], batch["bytes"], strict=True):
                rows = []
                with tarfile.open(fileobj=io.BytesIO(unpacked(content))) as tar:
                    for i, m in enumerate(tar):
                        kind = "directory" if m.isdir() else "symlink" if m.issym() else "hardlink" if m.islnk() else "file" if m.isfile() else None
                        if kind:
                            rows.append((layer, (int(layer) << 32) + i, m.name, kind, m.mode, int(m.mtime), m.linkname or None, tar.extractfile(m).read() if kind == "file" else None))
                yield pd.DataFrame(rows, columns=["layer", "ord", "path", "kind", "mode", "mtime", "link_target", "bytes"])

    return archives.select("layer", "bytes").mapInPandas(run, f"layer long, ord long, {MEMBERS}")


def with_compression(blobs: DataFrame, content: str = "bytes") -> DataFrame:
    return blobs.withColumn("compression", compression(F.col(content)))


def platform_manifest(indexes: DataFrame, os_name: str, arch: str) -> DataFrame:
    """indexes (manifests array<struct<digest, platform struct<os, architecture>>>) with `digest` of the first that fits, or null."""
    fits = F.filter("manifests", lambda m: (m["platform"]["os"] == os_name) & (m["platform"]["architecture"] == arch))
    return indexes.withColumn("digest", F.get(fits, F.lit(0))["digest"])


INDEX_DEPTH = 4


def resolve_manifest(manifests: DataFrame, root: str, os_name: str, arch: str) -> str:
    """Digest of the manifest with layers that an index leads to: (digest, manifests, layers) rows, indexes nested at most four deep, the first entry with the platform at each."""
    digest = root
    for _ in range(INDEX_DEPTH + 1):
        row = platform_manifest(manifests.where(F.col("digest") == digest).withColumnRenamed("digest", "own"), os_name, arch).first()
        if row is None:
            raise FileNotFoundError(f"manifest {digest}")
        if not row["manifests"]:
            if not row["layers"]:
                raise ValueError(f"manifest {digest} has no layers")
            return digest
        if row["digest"] is None:
            raise ValueError(f"no manifest for {os_name}/{arch} in {digest}")
        digest = row["digest"]
    raise ValueError(f"index nested deeper than {INDEX_DEPTH}")


def read_instances(spark: SparkSession, where: str) -> DataFrame:
    """Instances from <where>/<id>/config.json with the files pid ('pid' or 'pid:start'), exitcode and restarts beside it."""
    config = spark.read.schema("id string, container string, branch string, command array<string>, started_unix long").option("multiLine", True).json(f"{where}/*/config.json")
    side = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(where).select(F.element_at(F.split("path", "/"), -2).alias("id"), F.element_at(F.split("path", "/"), -1).alias("f"), F.trim(F.col("content").cast("string")).alias("v")).where(F.col("f").isin("pid", "exitcode", "restarts"))
    of = lambda f: F.max(F.when(F.col("f") == f, F.col("v")))
    flat = side.groupBy("id").agg(of("pid").alias("p"), of("exitcode").alias("x"), of("restarts").alias("r"))
    return config.join(flat, "id", "left").select(*config.columns, F.regexp_extract("p", r"^(\d+)", 1).try_cast("int").alias("pid"), F.regexp_extract("p", r":(\d+)$", 1).try_cast("long").alias("start"), F.col("x").try_cast("int").alias("exit_code"), F.coalesce(F.col("r").try_cast("int"), F.lit(0)).alias("restarts"))


def read_peers(spark: SparkSession, text: str) -> DataFrame:
    """Peers of a TOML text: a table per name with address, pubkey and role; incomplete ones are left out."""
    found = [(n, t.get("address"), t.get("pubkey"), t.get("role", "read")) for n, t in tomllib.loads(text).get("peers", {}).items() if isinstance(t, dict)]
    return spark.createDataFrame([r for r in found if r[1] and r[2]], PEER)


def read_text_lines(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.text(where)


def write_peers(peers: DataFrame) -> str:
    """The TOML text that read_peers reads, names in order."""
    quoted = lambda x: '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'
    rows = sorted(peers.select("name", "address", "pubkey", "role").collect())  # a registry of peers
    return "".join(f"[peers.{quoted(n)}]\naddress = {quoted(a)}\npubkey = {quoted(k)}\nrole = {quoted(r)}\n" for n, a, k, r in rows)


APP_FIELDS = ("image", "name", "setup", "run", "bin", "user", "env", "env_pass", "autocommit", "workspace", "display")
GRACE_SECONDS = 10


def read_project(text: str, profile: str | None = None) -> dict:
    """`app` and `deploy` of a project's TOML text; a named profile's fields go over the base.

    A text without any field of an app and without a named profile has no app. An app needs an image; a deploy table needs container and
    branch, its run command isn't empty, and its grace is ten seconds unless given.
    """
    raw = tomllib.loads(text)
    profiles, deploy = raw.get("profile", {}), raw.get("deploy")
    if profile is not None and profile not in profiles:
        raise ConfigError(f"no profile {profile!r}; there are: {', '.join(sorted(profiles))}")
    base = {f: raw[f] for f in APP_FIELDS if f in raw}
    app = None
    if profile is not None or any(v not in ({}, []) for v in base.values()):
        over = profiles.get(profile, {}) if profile else {}
        app = base | {f: over[f] for f in APP_FIELDS if f in over}
        app["env"] = base.get("env", {}) | over.get("env", {})
        app["env_pass"] = list(dict.fromkeys([*base.get("env_pass", []), *over.get("env_pass", [])]))
        if not str(app.get("image", "")).strip():
            raise ConfigError("image is required")
    if deploy is not None:
        for f in ("container", "branch"):
            if not deploy.get(f):
                raise ConfigError(f"[deploy]: {f} is required")
        run = deploy.get("run")
        if run is not None and (not str(run).strip() if isinstance(run, str) else not run or not str(run[0]).strip()):
            raise ConfigError("[deploy]: run must not be empty")
        deploy = {"grace_secs": GRACE_SECONDS, "network": None, "ports": [], "volumes": [], "run": None} | deploy
    return {"app": app, "deploy": deploy}
