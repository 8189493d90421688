import pytest
from pyspark.sql import functions as F

from keyspan.functions import paths, scalars
from keyspan.operators import config, instances


def check(spark, f, cases):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i")
    got = [r["y"] for r in df.collect()]
    assert got == list(cases.values()), dict(zip(cases, got, strict=True))


def test_paths(spark):
    check(spark, paths.normalize_path, {"./a//b/": "a/b", "": "", "/": "", "../x": None, "a/..": None, "a\x00b": None, "...": "...", "é/ü": "é/ü"})
    check(spark, paths.normalize_archive_path, {"./": None, ".": None, "./a": "a"})
    check(spark, paths.collapse_dotdot, {"/a/../b": "/b", "../../x": "/x", "": "/", "a/./b//c/..": "/a/b"})
    check(spark, paths.parent_of, {"a/b/c": "a/b", "a": "", "": ""})
    check(spark, paths.name_of, {"a/b/c": "c", "a": "a"})
    check(spark, paths.strict_ancestors, {"a/b/c": ["a", "a/b"], "a": []})
    check(spark, lambda c: paths.apply_cwd(F.lit("/w/"), c), {"/x": "/x", "": "/w", "y": "/w/y"})
    check(spark, lambda c: paths.apply_cwd(F.lit("/"), c), {"": "/", "y": "/y"})
    check(spark, lambda c: paths.split_ref(c)["ref"], {"main:a/b": "main", "a/b:c": None, ":x": None, "x": None, "m:": "m"})
    check(spark, lambda c: paths.split_ref(c)["path"], {"main:a:b": "a:b", "a/b:c": "a/b:c", "m:": ""})
    check(spark, lambda c: paths.strip_mount(c, "proc"), {"proc": "", "proc/1/x": "1/x", "process": None})
    route = lambda c: F.concat_ws("|", paths.route(c)["target"], F.coalesce(paths.route(c)["name"], F.lit("-")), F.coalesce(paths.route(c)["path"], F.lit("-")))
    check(spark, route, {"/containers": "containers|-|-", "containers/": "containers|-|-", "/containers/c": "container|c|", "containers/c/a/b": "container|c|a/b", "/workspace": "workspace|-|", "workspace/x": "workspace|-|x", "//peers/p": "peers|-|p", "etc/x": "local|-|etc/x"})
    check(spark, lambda c: paths.resolve_cd(F.lit("/a"), c), {"../b": "/b", "c": "/a/c"})


def test_scalars(spark):
    check(spark, scalars.parse_size, {"512": 512, "512K": 524288, "64m": 67108864, " 2G ": 2147483648, "7B": 7, "": None, "x": None, "1.5K": None, "99999999999999999999": None, "9999999999G": None})
    check(spark, lambda c: scalars.format_ts(c.cast("long")), {"951782400": "2000-02-29 00:00:00 UTC", "0": "1970-01-01 00:00:00 UTC"})
    ref = lambda c: F.concat_ws("|", scalars.image_ref(c)["registry"], scalars.image_ref(c)["repo"], scalars.image_ref(c)["reference"])
    check(spark, ref, {
        "busybox": "registry-1.docker.io|library/busybox|latest", "busybox:1": "registry-1.docker.io|library/busybox|1", "me/app@sha256:ab": "registry-1.docker.io|me/app|sha256:ab",
        "localhost/x": "localhost|x|latest", "host:5000/x:2": "host:5000|x|2", "ghcr.io/a/b": "ghcr.io|a/b|latest", " ": ""})
    check(spark, scalars.image_name, {"host:5000/team/x:2": "x", "busybox": "busybox"})
    check(spark, scalars.valid_name, {"main": True, "": False, "a/b": False, "a..b": False, ".x": False, "-x": False, "a.b-c": True})
    check(spark, lambda c: scalars.volume_spec(c)["readonly"], {"/a:/b": False, "/a:/b:ro": True, "/a:/b:rw": False, "/a:/b:zz": None, "/a:b": None, "/a": None, ":/b": None})
    check(spark, lambda c: scalars.truncate(c, 4), {"abcd": "abcd", "abcde": "abc…", "ééé": "é…", "": ""})
    check(spark, scalars.compression, {"plain": "raw", "": "raw"})
    check(spark, lambda c: scalars.author(c, F.lit("env")), {"": "env", "me": "me"})
    check(spark, scalars.is_hex_prefix, {"aB1": True, "": False, "g": False})
    check(spark, lambda c: scalars.role_allows(c, F.lit("sync")), {"read": False, "sync": True, "deploy": True, "?": False})
    check(spark, lambda c: scalars.argv(c, F.lit(None).cast("array<string>")), {"ls": ["/bin/sh", "-c", "ls"]})
    check(spark, lambda c: scalars.splice(c, F.lit(4), F.lit("XY")).cast("string"), {"abcdefg": "abcdXYg", "ab": "ab\0\0XY"})
    check(spark, lambda c: scalars.resize(c, F.lit(3)).cast("string"), {"abcdefg": "abc", "a": "a\0\0"})
    check(spark, lambda c: scalars.read_range(c, F.lit(2), F.lit(3)).cast("string"), {"abcdefg": "cde", "abc": "c", "a": ""})


@pytest.mark.parametrize("policy, code, again", [("no", 1, False), ("on-failure", 0, False), ("on-failure", 137, True), ("always", 0, True)])
def test_restart_table(spark, policy, code, again):
    assert spark.range(1).select(scalars.wants_restart(F.lit(policy), F.lit(code))).first()[0] is again


def test_config(spark):
    base = spark.createDataFrame([("a", "img", None, ["x"])], "app string, image string, net string, run array<string>")
    profiles = spark.createDataFrame([("dev", "a", None, ["y", "z"]), ("prod", "a", "img2", None)], "profile string, app string, image string, run array<string>")
    dev = config.overlay(base, config.pick_profile(profiles, "dev").drop("profile"), ["app"], {"net": "none"}).first()
    assert (dev["image"], dev["net"], dev["run"]) == ("img", "none", ["y", "z"])
    with pytest.raises(config.ConfigError, match="dev, prod"):
        config.pick_profile(profiles, "ci")
    bad = spark.createDataFrame([(" ", ["x"]), ("i", []), ("i", None), ("i", ["a", " "])], "image string, run array<string>")
    assert sorted(r["problem"] for r in config.problems(bad).collect()) == ["image is required", "run has a blank word", "run is empty"]
    steps = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "position int, step string")
    done = config.pending_steps(steps, spark.createDataFrame([], "hash string"))
    assert sorted((r["position"], r["step"]) for r in done.collect()) == [(1, "a"), (2, "b")]
    assert config.pending_steps(steps, done).count() == 0
    lines = spark.createDataFrame([(0, "# c"), (1, "container=x"), (2, ""), (3, "cwd=/a=b"), (4, "container=y")], "position int, value string")
    assert tuple(config.parse_session(lines).first()) == ("y", "/a=b")
    assert tuple(config.parse_session(lines.limit(0)).first()) == ("main", "/")


def test_instances(spark):
    rows = spark.createDataFrame([("1", 10, 5, None), ("2", 11, 5, None), ("3", 12, None, None), ("4", 13, 5, 3), ("5", None, None, None), ("6", 14, 1, None)], "id string, pid int, start long, exit_code int").selectExpr("*", "'c' AS container", "'b' AS branch", "cast(id AS long) AS started_unix")
    processes = spark.createDataFrame([(10, 5), (11, 6), (12, 9), (14, None)], "pid int, start long")
    got = {r["id"]: r["status"] for r in instances.ps(rows, processes, everything=True).collect()}
    assert got == {"1": "running (pid 10)", "2": "dead", "3": "running (pid 12)", "4": "exited (3)", "5": "spawning", "6": "dead"}
    assert [r["id"] for r in instances.listed(instances.ps(rows, processes)).collect()] == ["3", "1"]


def test_backoff(spark):
    ups = [1] * 8 + [70, 1, 1]
    rows = spark.createDataFrame([("i", n, float(u), 1, "on-failure") for n, u in enumerate(ups)] + [("i", 11, 1.0, 0, "on-failure"), ("i", 12, 1.0, 1, "on-failure")], "id string, attempt long, up_seconds double, exit_code int, policy string")
    got = [(r["wait"], r["restarts"]) for r in instances.backoff(rows).orderBy("attempt").collect()]
    assert got == list(zip([1, 2, 4, 8, 16, 32, 60, 60, 1, 2, 4], range(1, 12))) + [(None, 11)]
