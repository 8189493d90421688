import itertools

import pytest
from pyspark.sql import functions as F

from keyspan.sources.store import RefConflict, Store
from keyspan.sources.workspace import Workspace, WorkspaceError, fetch, push


def changes(spark, **kv):
    return spark.createDataFrame([(k.replace("__", "/"), v) for k, v in kv.items()], "key string, value string")


def content(w):
    return {r["key"]: r["value"] for r in w.working().collect()}


@pytest.fixture
def work(spark, tmp_path):
    tick = itertools.count(100)
    w = Workspace(Store(spark, str(tmp_path / "s")), "me", lambda: next(tick))
    w.change(changes(spark, a="1", b="2", c="3"))
    assert w.status().count() == 3 and w.commit("one") and w.commit("again") is None
    return w


def test_commit_and_checkout(spark, work):
    one = work.head()
    work.make_branch("side")
    work.change(changes(spark, b=None, d="4"))
    assert sorted(tuple(r) for r in work.status().collect()) == [("b", "removed", "2", None), ("d", "added", None, "4")]
    with pytest.raises(WorkspaceError):
        work.checkout("side")
    two = work.commit("two")
    assert [r["message"] for r in work.log().collect()] == ["two", "one"] and work.store.commits().where(F.col("hash") == two).first()["parents"] == [one]
    assert work.checkout("side") and not work.checkout("side") and content(work) == {"a": "1", "b": "2", "c": "3"}
    with pytest.raises(WorkspaceError):
        work.checkout("nowhere")
    work.change(changes(spark, a="x"))
    assert work.checkout("main", force=True) and content(work) == {"a": "1", "c": "3", "d": "4"}


def test_merges(spark, work):
    work.make_branch("side")
    assert work.merge("side").outcome == "up to date"
    work.checkout("side")
    work.change(changes(spark, b="side", n="new"))
    side = work.commit("side")
    work.checkout("main")
    assert work.merge("side").outcome == "fast-forward" and work.head() == side
    work.change(changes(spark, a="main", c="main"))
    main = work.commit("main")
    work.checkout("side")
    work.change(changes(spark, b=None))
    side = work.commit("side again")
    work.checkout("main")
    done = work.merge("side")
    assert done.outcome == "merged" and content(work) == {"a": "main", "c": "main", "n": "new"}
    assert work.store.commits().where(F.col("hash") == done.commit).first()["parents"] == [main, side]
    work.checkout("side")
    work.change(changes(spark, a="side", n__x="below"))
    work.commit("conflicting")
    work.checkout("main")
    done = work.merge("side")
    assert done.outcome == "conflicts" and sorted((r["key"], r["conflict"]) for r in done.conflicts.collect()) == [("a", "both modified"), ("n", "file/directory")]
    assert content(work) == {"a": "<<<<<<< ours\nmain\n=======\nside\n>>>>>>> theirs\n", "c": "main", "n/x": "below"}
    work.abort()
    assert work.status().count() == 0


def test_revert(spark, work):
    one = work.head()
    work.change(changes(spark, a="2"))
    two = work.commit("two")
    assert work.revert("HEAD") is None
    three = work.revert(one[:12])
    assert content(work)["a"] == "1" and work.store.commits().where(F.col("hash") == three).first()["parents"] == [two]


def test_exchange(spark, work, tmp_path):
    there = Store(spark, str(tmp_path / "there"))
    assert push(work.store, there, "main") > 0 and push(work.store, there, "main") == 0
    other = Workspace(there, "you", lambda: 200)
    assert content(other) == {"a": "1", "b": "2", "c": "3"}
    other.change(changes(spark, z="9"))
    ahead = other.commit("ahead")
    work.change(changes(spark, y="8"))
    work.commit("apart")
    with pytest.raises(RefConflict):
        push(work.store, there, "main")
    assert fetch(work.store, there, "main", "theirs") > 0 and work.store.refs()["branch/theirs"] == ahead
    assert work.merge("theirs").outcome == "merged" and content(work) == {"a": "1", "b": "2", "c": "3", "y": "8", "z": "9"}
    assert push(work.store, there, "main") > 0 and there.refs()["branch/main"] == work.head()
    with pytest.raises(WorkspaceError):
        fetch(work.store, there, "nowhere")
