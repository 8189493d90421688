import pytest
from pyspark.sql import functions as F

from keyspan.operators import fsview, overlay
from keyspan.operators.fsview import PathError

ENTRY = "key string, kind string, size long, mode int, mtime long, target string, content_hash string"


def entries(spark, *keys):
    return spark.createDataFrame([(k, kind, 1, 0o644, 7, None, "h") for k, kind in ((k if isinstance(k, tuple) else (k, "file")) for k in keys)], ENTRY)


def keys(df):
    return sorted(r["key"] for r in df.collect())


@pytest.fixture
def tree(spark):
    return entries(spark, "a/b/c.txt", "a/d.txt", "z.txt", "a-", ("e", "directory"), ("l", "symlink"))


def test_ls(tree):
    assert sorted((r["name"], r["kind"], r["size"]) for r in fsview.ls(tree).collect()) == [("a", "directory", None), ("a-", "file", 1), ("e", "directory", 1), ("l", "symlink", 1), ("z.txt", "file", 1)]
    assert sorted((r["name"], r["kind"]) for r in fsview.ls(tree, "a").collect()) == [("b", "directory"), ("d.txt", "file")]
    assert fsview.ls(tree, "nope").count() == 0


def test_explicit_entry_beats_implied_directory(spark):
    both = entries(spark, ("e", "directory"), "e/f")
    assert [tuple(r) for r in fsview.ls(both).select("name", "kind", "size").collect()] == [("e", "directory", 1)]


def test_kinds(tree):
    found = lambda f, p: f(tree, p).first()["found"]
    assert [found(fsview.exists, p) for p in ("", "a", "a/b", "a/d.txt", "a/d", "nope")] == [True, True, True, True, False, False]
    assert [found(fsview.is_dir, p) for p in ("", "a", "z.txt", "e", "nope")] == [True, True, False, True, False]
    assert found(fsview.is_file, "z.txt") and found(fsview.is_symlink, "l") and not found(fsview.is_file, "a")


def test_tree_and_sizes(tree):
    assert sorted((r["path"], r["depth"]) for r in fsview.tree(tree, "a").collect()) == [("a/b", 1), ("a/b/c.txt", 2), ("a/d.txt", 1)]
    assert sorted(r["path"] for r in fsview.tree(tree, depth=1).collect()) == ["a", "a-", "e", "l", "z.txt"]
    sizes = {r["directory"]: (r["children"], r["files"], r["bytes"]) for r in fsview.dir_sizes(tree).collect()}
    assert sizes == {"": (5, 4, 4), "a": (2, 2, 2), "a/b": (1, 1, 1)}


def test_remove_copy_move(tree):
    assert keys(fsview.rm(tree, "a")) == ["a-", "e", "l", "z.txt"]
    assert keys(fsview.rm(tree, "nope")) == keys(tree)
    assert keys(fsview.mv(tree, "a", "n/m")) == ["a-", "e", "l", "n/m/b/c.txt", "n/m/d.txt", "z.txt"]
    assert keys(fsview.cp(tree, "z.txt", "a/d.txt")) == keys(tree)
    assert "e/b/c.txt" in keys(fsview.cp(tree, "a", "e")) and "e" not in keys(fsview.cp(tree, "a", "e"))
    with pytest.raises(PathError):
        fsview.rm(tree, "a", recursive=False)


@pytest.mark.parametrize("source, target", [("a", "a"), ("a", "a/b/x"), ("a/b", "a"), ("nope", "n"), ("a", ""), ("a/d.txt", "z.txt/x")])
def test_refused_copies(tree, source, target):
    with pytest.raises(PathError):
        fsview.cp(tree, source, target)


def test_writes(spark, tree):
    assert "a/new" in keys(fsview.write_files(tree, entries(spark, "a/new")))
    for bad in ("z.txt/x", "a", "l/x"):
        with pytest.raises(PathError):
            fsview.write_files(tree, entries(spark, bad))
    assert "e/x" in keys(fsview.write_files(tree, entries(spark, "e/x")))


def test_mkdir(tree):
    assert keys(fsview.mkdir(tree, "a")) == keys(tree)
    assert "n" in keys(fsview.mkdir(tree, "n"))
    for bad in ("z.txt", "z.txt/n"):
        with pytest.raises(PathError):
            fsview.mkdir(tree, bad)


def test_read_file(spark, tree):
    objects = spark.createDataFrame([("h", bytearray(b"x"))], "hash string, bytes binary")
    status = lambda p, o=objects: fsview.read_file(tree, o, p).first()["status"]
    assert [status(p) for p in ("z.txt", "a", "l", "nope")] == ["ok", "is a directory", "is a symlink", "not found"]
    assert status("z.txt", objects.limit(0)) == "missing content"


def test_delete_paths(spark, tree):
    assert keys(fsview.delete_paths(tree, spark.createDataFrame([("a",), ("l",), ("q",)], "key string"))) == ["a-", "e", "z.txt"]


def layers(spark, *rows):
    return spark.createDataFrame([(i, p, k, t, v) for i, (p, k, t, v) in enumerate(rows)], "ord long, path string, kind string, link_target string, value string")


def test_overlay(spark):
    m = layers(
        spark, ("./a/x", "file", None, "1"), ("a/y", "file", None, "2"), ("b/z", "file", None, "3"), ("../up", "file", None, "!"), ("c", "file", None, "4"), ("h", "hardlink", "a/x", None),
        ("a/.wh.y", "file", None, None), ("b/.wh..wh..opq", "file", None, None), ("b/new", "file", None, "5"), ("c", "file", None, "6"), (".wh.", "file", None, None), ("s", "symlink", "c", None), ("p", "fifo", None, None))
    got = {r["key"]: (r["kind"], r["value"]) for r in overlay.apply_layers(m).collect()}
    assert got == {"a/x": ("file", "1"), "b": ("directory", None), "b/new": ("file", "5"), "c": ("file", "6"), "h": ("file", "1"), "s": ("symlink", None)}


def test_overlay_whiteout_of_directory_then_again(spark):
    m = layers(spark, ("d/one", "file", None, "1"), ("d/two", "file", None, "2"), (".wh.d", "file", None, None), ("d/one", "file", None, "3"))
    assert {r["key"]: r["value"] for r in overlay.apply_layers(m).collect()} == {"d/one": "3"}
    assert overlay.apply_layers(m.where(F.lit(False))).count() == 0


def test_overlay_emptied_directories_stay(spark):
    m = layers(spark, ("d/x/one", "file", None, "1"), ("d/.wh..wh..opq", "file", None, None), ("e/.wh..wh..opq", "file", None, None), ("f/x", "file", None, "2"), ("f/.wh.x", "file", None, None), ("f/.wh..wh..opq", "file", None, None), ("g", "directory", None, "3"), ("g/y", "file", None, "4"), ("g/.wh..wh..opq", "file", None, None), ("g/.wh..wh..opq", "file", None, None), ("h/z", "file", None, "5"), ("h/.wh..wh..opq", "file", None, None), (".wh.h", "file", None, None))
    assert {r["key"]: (r["kind"], r["value"]) for r in overlay.apply_layers(m).collect()} == {"d": ("directory", None), "g": ("directory", None)}


def test_overlay_links(spark):
    m = layers(spark, ("d/x/one", "file", None, "1"), ("d/two", "file", None, "2"), ("d/three", "hardlink", "d/two", None), ("copy", "hardlink", "./d", None), ("d/late", "file", None, "3"), ("d/.wh.two", "file", None, None))
    assert {r["key"]: r["value"] for r in overlay.apply_layers(m).collect()} == {"d/x/one": "1", "d/three": "2", "d/late": "3", "copy/x/one": "1", "copy/two": "2", "copy/three": "2"}
    with pytest.raises(overlay.OverlayError):
        overlay.apply_layers(layers(spark, ("a", "hardlink", "nowhere", None)))


def test_overlay_refuses_members_below_a_file(spark):
    with pytest.raises(Exception, match="lies below"):
        overlay.apply_layers(layers(spark, ("a/x", "file", None, "1"), ("a/x/y", "file", None, "2"))).collect()
    m = layers(spark, ("a/x", "file", None, "1"), (".wh.a", "file", None, None), ("a/x/y", "file", None, "2"))
    assert {r["key"]: r["value"] for r in overlay.apply_layers(m).collect()} == {"a/x/y": "2"}
