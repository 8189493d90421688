import gzip
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from keyspan.operators import overlay
from keyspan.operators.config import ConfigError
from keyspan.sources import files
from keyspan.sources.store import RefConflict, Store
from keyspan.streaming import feeds


def snap(spark, d):
    return spark.createDataFrame(list(d.items()), "key string, value string")


def test_objects(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([(bytearray(b"x" * 99),), (bytearray(b"x" * 99),), (bytearray(b"y"),)], "bytes binary")
    s.put(rows)
    s.put(rows)
    assert s.objects().count() == s.intact().count() == s.find("").count() == 2
    one = s.objects().first()["hash"]
    assert s.find(one[:8].upper()).count() == 1 and s.find("zz").count() == 0
    s.delete(s.objects().where(F.col("hash") == one).select("hash"))
    assert [r["hash"] for r in s.objects().collect()] != [one] and s.objects().count() == 1


def test_snapshots(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    a = {f"k-{i:04d}": str(i) for i in range(300)}
    one, two = s.write_snapshot(snap(spark, a)), s.write_snapshot(snap(spark, a | {"k-0007": "new"}))
    assert s.write_snapshot(snap(spark, dict(reversed(a.items())))) == one != two
    assert s.count(one) == s.snapshot(one).count() == 300
    assert [tuple(r) for r in s.diff(one, two).collect()] == [("k-0007", "modified", "7", "new")]
    assert s.diff(one, one).count() == 0
    empty = s.write_snapshot(snap(spark, a).limit(0))
    assert s.count(empty) == s.snapshot(empty).count() == 0
    assert s.diff(empty, one).count() == 300


def test_damaged_objects(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([(bytearray(b"x" * 99),), (bytearray(b"y"),)], "bytes binary")
    named = s.put(rows).select("hash").collect()
    bad = s.objects().where(F.col("hash") == named[0]["hash"]).withColumn("bytes", F.lit(bytearray(b"z"))).select("hash", "kind", "bytes", "shard").collect()
    s.delete(spark.createDataFrame([(named[0]["hash"],)], "hash string"))
    spark.createDataFrame(bad, "hash string, kind string, bytes binary, shard string").write.mode("append").partitionBy("shard").parquet(f"{s.root}/objects")
    wanted = spark.createDataFrame([(r["hash"],) for r in named] + [("0" * 64,)], "hash string")
    assert sorted(r["status"] for r in s.read(wanted).collect()) == ["corrupt", "missing", "ok"]
    assert s.quarantine() == 1 and s.quarantine() == 0 and s.objects().count() == 1
    s.put(rows)
    assert sorted(r["status"] for r in s.read(wanted).collect()) == ["missing", "ok", "ok"]


def test_deleting_keeps_the_rest_of_a_shard(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.put(spark.createDataFrame([(bytearray(str(i).encode()),) for i in range(600)], "bytes binary"))
    gone = s.objects().orderBy("hash").limit(150).select("hash").collect()
    # rows that a broken-off delete left twice
    s.objects().where("shard < '80'").write.mode("append").partitionBy("shard").parquet(f"{s.root}/objects")
    s.delete(spark.createDataFrame(gone, "hash string"))
    left = [r["hash"] for r in s.objects().select("hash").collect()]
    assert set(left) & {r["hash"] for r in gone} == set() and len(set(left)) == 450


def test_broken_off_snapshots_are_written_again(spark, tmp_path):
    import shutil

    s = Store(spark, str(tmp_path))
    rows = snap(spark, {f"k{i}": str(i) for i in range(50)})
    name = s.write_snapshot(rows)
    shutil.rmtree(tmp_path / "snapshots" / name)
    (tmp_path / "snapshots" / name).mkdir()
    with pytest.raises(FileNotFoundError):
        s.snapshot(name)
    assert s.write_snapshot(rows) == name and s.snapshot(name).count() == 50


def test_changes_touch_their_buckets_alone(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    a = {f"k{i}": str(i) for i in range(500)}
    one = s.write_snapshot(snap(spark, a))
    two = s.apply(one, spark.createDataFrame([("k7", "new"), ("k8", None)], "key string, value string"))
    assert two == s.write_snapshot(snap(spark, {k: v for k, v in (a | {"k7": "new"}).items() if k != "k8"}))
    homes = [{r["bucket"]: r["home"] for r in s.manifest(x).collect()} for x in (one, two)]
    assert 1 <= sum(homes[0][b] != h for b, h in homes[1].items()) <= 2
    assert sorted(tuple(r) for r in s.diff(one, two).collect()) == [("k7", "modified", "7", "new"), ("k8", "removed", "8", None)]


def test_divisions_of_different_size(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    a = {f"k{i}": str(i) for i in range(300)}
    one, two = s.write_snapshot(snap(spark, a), 64), s.write_snapshot(snap(spark, a | {"k3": "x"}), 256)
    assert [tuple(r) for r in s.diff(one, two).collect()] == [("k3", "modified", "3", "x")]


def test_a_crash_leaves_the_references(spark, tmp_path):
    s = Store(spark, str(tmp_path), lock_seconds=0.5)
    s.set_ref("branch", "main", "c1")
    (tmp_path / "refs" / "fresh-dead").write_text("{broken")
    (tmp_path / "refs" / "lock").write_text("dead")
    assert s.refs() == {"branch/main": "c1"}
    with pytest.raises(RefConflict):
        Store(spark, str(tmp_path)).set_ref("branch", "main", "c2", expected="c1")
    import time

    time.sleep(1.2)
    s.set_ref("branch", "main", "c2", expected="c1")
    assert s.refs() == {"branch/main": "c2"} and not (tmp_path / "refs" / "lock").exists()
    with pytest.raises(RefConflict):
        s.set_refs({"branch/main": ("c3", "c2"), "branch/x": ("c1", "c9")})
    assert s.refs() == {"branch/main": "c2"}


def test_references(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    c1 = s.commit("t1", [], "me", "one", 1)
    c2 = s.commit("t2", [c1], "me", "two", 2)
    s.set_ref("branch", "main", c1)
    with pytest.raises(RefConflict):
        s.set_ref("branch", "main", c2)
    s.set_ref("branch", "main", c2, expected=c1)
    s.set_ref("tag", "v1", c1)
    with pytest.raises(RefConflict):
        s.set_ref("tag", "v1", c2, expected=c1)
    assert s.refs() == {"branch/main": c2, "tag/v1": c1}
    assert s.commits().count() == s.refs_frame().count() == 2
    s.set_ref("branch", "main", None, expected=c2)
    assert "branch/main" not in s.refs()


def test_directories(spark, tmp_path):
    (tmp_path / "in/d/deep").mkdir(parents=True)
    (tmp_path / "in/d/ä b.txt").write_bytes(b"hello")
    (tmp_path / "in/d/deep/x").write_bytes(b"x")
    (tmp_path / "in/e").write_bytes(b"")
    (tmp_path / "in/d/link").symlink_to("../e")
    (tmp_path / "in/away").symlink_to("d")
    found = files.read_directory(spark, str(tmp_path / "in"))
    rows = {r["key"]: (r["kind"], r["size"], r["target"]) for r in found.collect()}
    assert rows == {"d/ä b.txt": ("file", 5, None), "d/deep/x": ("file", 1, None), "e": ("file", 0, None), "d/link": ("symlink", 0, "../e"), "away": ("symlink", 0, "d")}
    out = str(tmp_path / "out")
    assert files.write_directory(found, out) == 5
    assert (tmp_path / "out/e").read_bytes() == b"" and (tmp_path / "out/d/link").readlink().as_posix() == "../e" and (tmp_path / "out/away/deep/x").read_bytes() == b"x"
    with pytest.raises(FileExistsError):
        files.write_directory(found, out)
    assert files.write_directory(found, out, overwrite=True) == 5
    assert files.read_directory(spark, str(tmp_path / "in/d/deep")).count() == 1


def test_manifests_and_projects(spark):
    index = lambda *m: [(d, (o, a)) for d, o, a in m]
    schema = "digest string, manifests array<struct<digest string, platform struct<os string, architecture string>>>, layers array<string>"
    rows = [("top", index(("a", "linux", "arm64"), ("in", "linux", "amd64")), []), ("in", index(("leaf", "linux", "amd64")), []), ("leaf", [], ["l1"]), ("a", [], []), ("loop", index(("loop", "linux", "amd64")), [])]
    m = spark.createDataFrame(rows, schema)
    assert files.resolve_manifest(m, "top", "linux", "amd64") == "leaf"
    for root, arch, why in (("top", "arm64", "no layers"), ("top", "x", "no manifest"), ("loop", "amd64", "deeper")):
        with pytest.raises(ValueError, match=why):
            files.resolve_manifest(m, root, "linux", arch)
    text = 'image = "i"\n[env]\nA = "1"\n[profile.dev]\nrun = "x"\n[profile.dev.env]\nB = "2"\n[deploy]\ncontainer = "c"\nbranch = "b"\n'
    got = files.read_project(text, "dev")
    assert got["app"] == {"image": "i", "env": {"A": "1", "B": "2"}, "run": "x", "env_pass": []} and got["deploy"]["grace_secs"] == 10
    assert files.read_project('[deploy]\ncontainer = "c"\nbranch = "b"')["app"] is None
    for bad, why in (('name = "x"', "image"), ('[deploy]\nbranch = "b"', "container"), ('[deploy]\ncontainer = "c"\nbranch = "b"\nrun = []', "run"), ('[deploy]\ncontainer = "c"\nbranch = "b"\nrun = " "', "run")):
        with pytest.raises(ConfigError, match=why):
            files.read_project(bad)
    with pytest.raises(ConfigError, match="dev"):
        files.read_project(text, "prod")
    peers = files.read_peers(spark, '[peers.b]\naddress = "h:2"\npubkey = "k\\"2"\n[peers.a]\naddress = "h:1"\npubkey = "k"\nrole = "sync"\n')
    assert sorted(files.read_peers(spark, files.write_peers(peers)).collect()) == sorted(peers.collect())


def tarball(*members):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        for name, content, kind, link in members:
            info = tarfile.TarInfo(name)
            info.type, info.linkname, info.size = kind, link, len(content)
            tar.addfile(info, io.BytesIO(content))
    return raw.getvalue()


def test_layers(spark):
    import zstandard

    low = gzip.compress(tarball(("a/x", b"1", tarfile.REGTYPE, ""), ("a/y", b"2", tarfile.REGTYPE, ""), ("h", b"", tarfile.LNKTYPE, "a/x"), ("fifo", b"", tarfile.FIFOTYPE, "")))
    high = zstandard.ZstdCompressor().compress(tarball(("a/.wh.y", b"", tarfile.REGTYPE, ""), ("s", b"", tarfile.SYMTYPE, "a/x"), ("d", b"", tarfile.DIRTYPE, "")))
    archives = spark.createDataFrame([(1, bytearray(high)), (0, bytearray(low))], "layer long, bytes binary")
    assert sorted(r["compression"] for r in files.with_compression(archives).collect()) == ["gzip", "zstd"]
    got = {r["key"]: (r["kind"], bytes(r["bytes"]) if r["bytes"] is not None else None) for r in overlay.apply_layers(files.read_layers(archives)).collect()}
    assert got == {"a/x": ("file", b"1"), "h": ("file", b"1"), "s": ("symlink", None), "d": ("directory", None)}


def test_small_sources(spark, tmp_path):
    box = tmp_path / "run/i1"
    box.mkdir(parents=True)
    (box / "config.json").write_text('{"id": "i1", "container": "c", "branch": "b", "command": ["x"], "started_unix": 5}')
    (box / "pid").write_text("12:99\n")
    (box / "exitcode").write_text("3")
    row = files.read_instances(spark, str(tmp_path / "run")).first()
    assert (row["pid"], row["start"], row["exit_code"], row["restarts"]) == (12, 99, 3, 0)
    peers = files.read_peers(spark, '[peers.a]\naddress = "h:1"\npubkey = "k"\nrole = "sync"\n[peers.b]\naddress = "x"\n')
    assert [tuple(r) for r in peers.collect()] == [("a", "h:1", "k", "sync")]
    index = spark.createDataFrame([([("d1", ("linux", "arm64")), ("d2", ("linux", "amd64"))],)], "manifests array<struct<digest string, platform struct<os string, architecture string>>>")
    assert files.platform_manifest(index, "linux", "amd64").first()["digest"] == "d2"
    assert files.platform_manifest(index, "x", "y").first()["digest"] is None


def test_change_feed_and_tail(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    apply = feeds.commit_feed(store, "main")
    batch = spark.createDataFrame([("a", "1", 0), ("b", "2", 1), ("a", "3", 2)], "key string, value string, ord int")
    apply(batch, 0)
    apply(batch, 0)
    apply(spark.createDataFrame([("b", None, 0), ("c", "4", 1)], "key string, value string, ord int"), 1)
    tip = store.refs()["branch/main"]
    tree = store.commits().where(F.col("hash") == tip).first()["tree"]
    assert sorted((r["key"], r["value"]) for r in store.snapshot(tree).collect()) == [("a", "3"), ("c", "4")]
    assert store.commits().count() == 2
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/out.txt").write_text("one\ntwo\n")
    q = feeds.follow_logs(spark, str(tmp_path / "logs")).writeStream.format("memory").queryName("tailed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["value"] for r in spark.table("tailed").collect()) == ["one", "two"]


def test_a_log_is_followed_to_its_end(tmp_path):
    log, steps = tmp_path / "log", [b"one\n", "t\u00e4".encode()[:2], "t\u00e4".encode()[2:] + b"wo\n", None, b"three\n"]

    def running():
        if not steps:
            return False
        step = steps.pop(0)
        if step is None:
            log.write_bytes(b"")
        else:
            with log.open("ab") as f:
                f.write(step)
        return True

    tail = feeds.LogTail(str(log))
    assert tail.read() == "" and list(feeds.followed(tail, running, sleep=lambda _: None)) == ["one\n", "t", "\u00e4wo\n", "three\n"]
    assert feeds.LogTail(str(log), 2).read() == "ree\n"


def test_supervised_waits_stream(spark, tmp_path):
    schema = "id string, attempt long, up_seconds double, exit_code int, policy string"
    spark.createDataFrame([("i", n, u, 1, "always") for n, u in enumerate([1.0, 1.0, 70.0, 1.0])], schema).write.parquet(str(tmp_path / "in"))
    stream = feeds.supervised_waits(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("waits").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["attempt"], r["wait"], r["restarts"]) for r in spark.table("waits").collect()) == [(0, 1, 1), (1, 2, 2), (2, 1, 3), (3, 2, 4)]
