import pytest
from pyspark.sql import functions as F

from keyspan.operators import history, maintenance
from keyspan.operators.history import HistoryError
from keyspan.plans import catalogue, inputs
from tests.conftest import SF


def graph(spark, edges, ts=None):
    """edges: node -> parents."""
    return spark.createDataFrame([(h, p, f"t{h}", "me", "m", (ts or {}).get(h, i)) for i, (h, p) in enumerate(edges.items())], "hash string, parents array<string>, tree string, author string, message string, ts long")


def test_log_newest_first_ties_by_discovery(spark):
    g = graph(spark, {"a": [], "b": ["a"], "c": ["a"], "d": ["c", "b"]}, {"a": 1, "b": 2, "c": 2, "d": 3})
    assert [r["hash"] for r in history.log(g, "d").collect()] == ["d", "c", "b", "a"]


def test_levels_agree_with_the_driver(spark):
    """The walk by level finds what the walk on the driver does, in the same order, with ties in time too."""
    edges = {str(i): [str(i - 1)] * (i > 0) + [str(i - 5)] * (i > 9 and i % 3 == 0) for i in range(40)} | {"z": [], "a": [], "m": ["z", "a"], "top": ["m", "39"]}
    g = graph(spark, edges, {h: 1 for h in ("z", "a", "m")})
    for starts in ("39", "top", ["m", "20", "m"]):
        near = {tuple(r) for r in history.ancestors(g, starts).collect()}
        far = {tuple(r) for r in history.ancestors(g, starts, driver_commits=3).collect()}
        assert near == far and len(near) >= 22
    near, far = ([(r["position"], r["hash"]) for r in history.log(g, "top", limit).collect()] for limit in (100, 3))
    assert near == far and [p for p, _ in near] == list(range(len(edges)))
    for pair in (("39", "m"), ("39", "38"), ("top", "20")):
        assert history.merge_base(g, *pair).collect() == history.merge_base(g, *pair, driver_commits=3).collect()


def test_numbers_agree_with_levels(spark):
    """The walks by number and by level: same commits, same order, whatever the parents' order, and the same log."""
    edges = {str(i): [str(j) for j in (i - 5, i - 1, i - 3) if j >= 0][::1 if i % 2 else -1] for i in range(14)} | {"z": [], "a": None, "top": ["z", "13", "a"]}
    g = graph(spark, edges, {str(i): i // 4 for i in range(14)})
    for starts in (["top", "z", "top"], []):
        near, far, levels = ([tuple(r) for r in history.ancestors(g, starts, *limits).orderBy("rank").collect()] for limits in ((100,), (3,), (3, 0)))
        assert near == far == levels
    near, far = ([tuple(r) for r in history.log(g, "top", limit).collect()] for limit in (100, 3))
    assert near == far and len(near) == len(edges)


def test_deep_history_takes_few_tables(spark, monkeypatch):
    """A walk beyond the driver's dictionary makes no table, and so no jobs, for each level."""
    made = []
    monkeypatch.setattr(history, "written", lambda df, written=history.written: made.append(1) or written(df))
    g = graph(spark, {str(i): [str(i - 1)] * (i > 0) for i in range(40)})
    got = history.ancestors(g, "39", driver_commits=3).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(str(39 - i), i, i) for i in range(40)]
    assert len(made) <= 5
    with pytest.raises(HistoryError, match="missing commit zz"):
        history.ancestors(g, ["39", "zz"], driver_commits=3)


def test_numbers_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(history, "BLOCK", 7)
    edges = {f"{i:02}": [f"{j:02}" for j in (i // 2, i - 1) if 0 <= j < i] for i in range(30)}
    g = graph(spark, edges)
    near, far = ({tuple(r) for r in history.ancestors(g, "29", limit).collect()} for limit in (100, 3))
    assert near == far and len(near) == 30


def test_walk_of_all_events(spark):
    """The catalogue's graph against a plain walk."""
    commits = inputs.commit_graph(spark, SF)
    parents = {r["hash"]: r["parents"] for r in commits.collect()}
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    start = inputs.tips(spark, SF)[0]
    seen, todo = {start}, [start]
    while todo:
        for p in parents[todo.pop()]:
            if p not in seen:
                seen.add(p)
                todo.append(p)
    assert len(parents) == events and {r["hash"] for r in catalogue.ancestors(spark, SF).collect()} == seen


def test_merge_bases(spark):
    lowest = graph(spark, {"g": [], "l": ["g"], "p": ["l"], "ours": ["p"], "q": ["l"], "theirs": ["q", "g"]})
    assert history.merge_base(lowest, "ours", "theirs").first()["hash"] == "l"
    cross = graph(spark, {"root": [], "A": ["root"], "B": ["root"], "ours": ["A", "B"], "theirs": ["A", "B"]}, {"root": 0, "A": 1, "B": 1, "ours": 2, "theirs": 2})
    assert history.merge_base(cross, "ours", "theirs").first()["hash"] == history.merge_base(cross, "theirs", "ours").first()["hash"] == "B"
    assert history.merge_base(graph(spark, {"a": [], "b": []}), "a", "b").count() == 0
    assert history.merge_base(lowest, "l", "ours").first()["hash"] == "l"
    assert history.is_ancestor(lowest, "l", "ours") and not history.is_ancestor(lowest, "ours", "l")


def test_missing_commit(spark):
    g = graph(spark, {"b": ["a"]})
    for limit in (10, 0):
        with pytest.raises(HistoryError):
            history.ancestors(g, "b", driver_commits=limit).collect()


def test_resolve(spark):
    h = ["ab" * 32, "abab12" + "c" * 58]
    g = graph(spark, {h[0]: [], h[1]: [h[0]]})
    refs = spark.createDataFrame([("c", "branch", "main", h[1]), ("c", "tag", "main", h[0]), ("c", "tag", "v1", h[0])], "container string, kind string, name string, commit string")
    assert history.resolve(g, refs, "main") == h[1]
    assert history.resolve(g, refs, "v1") == history.resolve(g, refs, h[0].upper()) == history.resolve(g, refs, "head", h[0]) == h[0]
    assert history.resolve(g, refs, "ABAB12") == h[1]
    for bad in ("abab1", "ab" * 10 + "ff", "nope"):
        with pytest.raises(HistoryError):
            history.resolve(g, refs, bad)
    two = graph(spark, {"aaaaaa1": [], "aaaaaa2": []})
    with pytest.raises(HistoryError, match="ambiguous"):
        history.resolve(two, refs, "aaaaaa")


def test_reachable_and_garbage(spark):
    g = graph(spark, {"a": [], "b": ["a"], "x": []})
    held = spark.createDataFrame([("ta", "o1", "blob"), ("tb", "o1", "blob"), ("tb", "o2", "blob"), ("tx", "o3", "blob")], "tree string, hash string, kind string")
    assert sorted(r["hash"] for r in history.reachable(g, ["b"], held).collect()) == ["a", "b", "o1", "o2"]
    refs = spark.createDataFrame([("c", "branch", "main", "b"), ("c", "tag", "only", "x"), ("c", "head", "HEAD", "zz")], "container string, kind string, name string, commit string")
    assert sorted(r["hash"] for r in maintenance.roots(refs).collect()) == ["b", "x"]
    objects = spark.createDataFrame([("o1", 5), ("o3", 7), ("o9", 11)], "hash string, n_bytes long")
    report = maintenance.gc_report(objects, spark.createDataFrame([("o1",), ("o1",)], "hash string")).first().asDict()
    assert report == {"total": 3, "reachable": 1, "deleted": 2, "bytes_freed": 18}


def test_fsck_and_transfer(spark):
    good = spark.createDataFrame([(bytearray(b"x"),), (bytearray(b"y"),)], "bytes binary").withColumn("hash", F.sha2("bytes", 256))
    bad = good.withColumn("bytes", F.lit(bytearray(b"z")))
    assert maintenance.fsck(good, good).count() == 0
    assert maintenance.fsck_report(good, bad.limit(1)).first().asDict() == {"checked": 2, "missing": 1, "corrupt": 1}
    assert maintenance.transfer(good, good, good.limit(1)).count() == 1
    assert maintenance.transfer(good, good, good).count() == 0


def test_send_batches(spark):
    rows = spark.createDataFrame([("p", "a", 4), ("p", "b", 4), ("p", "c", 4), ("p", "d", 30), ("p", "e", 1), ("q", "a", 4)], "peer string, hash string, n_bytes long")
    got = sorted((r["peer"], r["hash"], r["batch"]) for r in maintenance.send_batches(rows, cap=10).collect())
    assert got == [("p", "a", 0), ("p", "b", 0), ("p", "c", 1), ("p", "d", 2), ("p", "e", 3), ("q", "a", 0)]
