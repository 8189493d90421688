import itertools
import random

import pytest
from pyspark.sql import functions as F

from keyspan.operators import merge, setops, snapshot
from keyspan.plans import digests


def frame(spark, d):
    return spark.createDataFrame(list(d.items()), "key string, value string")


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture
def two():
    rng = random.Random(5)
    left = {f"k-{rng.randrange(60):03d}": rng.choice(["", "x", "y"]) for _ in range(40)}
    right = {f"k-{rng.randrange(60):03d}": rng.choice(["", "x", "y"]) for _ in range(40)}
    return left, right


def test_set_operations_follow_the_dict_model(spark, two):
    a, b = two
    left, right = frame(spark, a), frame(spark, b)
    assert pairs(setops.difference(left, right), "key", "value") == sorted((k, v) for k, v in a.items() if k not in b)
    assert pairs(setops.intersection(left, right), "key", "value") == sorted((k, v) for k, v in a.items() if b.get(k) == v)
    assert pairs(setops.union(left, right), "key", "value") == sorted((a | b).items())
    changes = {r["key"]: (r["change"], r["old"], r["new"]) for r in setops.diff(left, right).collect()}
    expected = {k: ("added", None, b[k]) for k in b.keys() - a.keys()} | {k: ("removed", a[k], None) for k in a.keys() - b.keys()} | {k: ("modified", a[k], b[k]) for k in a.keys() & b.keys() if a[k] != b[k]}
    assert changes == expected
    pruned = {r["key"]: (r["change"], r["old"], r["new"]) for r in digests.pruned_diff(left, right).collect()}
    assert pruned == expected


def test_a_snapshot_with_itself(spark, two):
    a = frame(spark, two[0])
    assert setops.diff(a, a).count() == setops.difference(a, a).count() == 0
    assert setops.intersection(a, a).count() == setops.union(a, a).count() == len(two[0])
    assert digests.changed_buckets(digests.bucket_digests(a), digests.bucket_digests(a)) == []


def test_null_values_are_no_absence(spark):
    a, b = frame(spark, {"k": None}), frame(spark, {"k": "v"})
    assert pairs(setops.union(b, a), "key", "value") == [("k", None)]
    assert setops.diff(a, b).first()["change"] == "modified"
    assert setops.intersection(a, a).count() == 1


def test_one_changed_key_changes_one_bucket(spark):
    base = spark.range(5000).select(F.format_string("key-%08d", "id").alias("key"), F.concat(F.lit("val-"), F.col("id")).alias("value"))
    other = base.withColumn("value", F.when(F.col("key") == "key-00000077", "new").otherwise(F.col("value")))
    assert len(digests.changed_buckets(digests.bucket_digests(base), digests.bucket_digests(other))) == 1
    assert pairs(digests.pruned_diff(base, other), "key", "old", "new") == [("key-00000077", "val-77", "new")]


def reference_merge(b, o, t):
    """The truth table, case by case."""
    if o == t:
        return o, None
    if b == o:
        return t, None
    if b == t:
        return o, None
    if b is None:
        return t, "both added"
    if o is None:
        return t, "delete/modify"
    if t is None:
        return o, "modify/delete"
    return t, "both modified"


def test_merge_truth_table(spark):
    cases = {f"{i:02d}": c for i, c in enumerate(itertools.product([None, "x", "y", ""], repeat=3))}
    sides = [frame(spark, {k: c[i] for k, c in cases.items() if c[i] is not None}) for i in range(3)]
    merged, conflicts = merge.three_way_merge(*sides)
    expected = {k: reference_merge(*c) for k, c in cases.items()}
    assert dict(pairs(merged, "key", "value")) == {k: m for k, (m, _) in expected.items() if m is not None}
    assert dict(pairs(conflicts, "key", "conflict")) == {k: c for k, (_, c) in expected.items() if c}


def test_file_and_directory_collide(spark):
    base, ours, theirs = frame(spark, {"z": "0"}), frame(spark, {"z": "0", "a": "1", "a-": "2"}), frame(spark, {"z": "0", "a/b": "3"})
    merged, conflicts = merge.three_way_merge(base, ours, theirs, paths=True)
    assert [k for k, _ in pairs(merged, "key", "value")] == ["a-", "a/b", "z"]
    assert pairs(conflicts, "key", "conflict", "conflict_rank") == [("a", "file/directory", 1)]


def test_markers(spark):
    df = spark.createDataFrame([("a\n", "b")], "o string, t string")
    assert df.select(merge.conflict_markers(F.col("o"), F.col("t"))).first()[0] == "<<<<<<< ours\na\n=======\nb\n>>>>>>> theirs\n"


def test_content_conflicts(spark):
    conflicts = spark.createDataFrame([("k", "both modified", "h1", "h2"), ("l", "modify/delete", "h1", None)], "key string, conflict string, ours string, theirs string")
    objects = spark.createDataFrame([("h1", bytearray(b"x")), ("h2", bytearray(b"y"))], "hash string, bytes binary")
    assert pairs(merge.content_conflicts(conflicts, objects), "key", "ours_text", "theirs_text") == [("k", "x", "y")]


def test_builds_and_changes(spark):
    entries = spark.createDataFrame([("k", "first", 1), ("k", "third", 3), ("k", "second", 2), ("j", None, 1)], "key string, value string, ord int")
    built = snapshot.bulk_build(entries, [F.col("ord")]).select("key", "value")
    assert pairs(built, "key", "value") == [("j", None), ("k", "third")]
    put = snapshot.put_many(built, frame(spark, {"k": "4", "m": "5"}))
    assert pairs(put, "key", "value") == [("j", None), ("k", "4"), ("m", "5")]
    assert pairs(snapshot.delete_many(put, frame(spark, {"m": "", "nope": ""})), "key", "value") == [("j", None), ("k", "4")]


def test_scans(spark):
    rows = frame(spark, {f"key-{i:08d}": str(i) for i in range(50)} | {"zzz": "z"})
    assert snapshot.scan_prefix(rows, "key-0000000").count() == 10
    assert snapshot.scan_prefix(rows, "").count() == snapshot.count(rows).first()["n"] == 51
    assert snapshot.seek(rows, "key-00000049x").first()["key"] == "zzz"
    assert snapshot.seek(rows, "zzzz").count() == 0
    assert [r["value"] for r in snapshot.page_after(rows, "key-00000047", 3).collect()] == ["48", "49", "z"]
    assert snapshot.page_after(rows, None, 1).first()["value"] == "0"
    assert snapshot.get(rows, "nope").count() == 0


def test_inline_boundary(spark):
    rows = spark.createDataFrame([("a", bytearray(64)), ("b", bytearray(65)), ("c", bytearray())], "key string, content binary")
    valued, objects = snapshot.store_values(rows, "content")
    assert pairs(valued.select("key", F.col("value.external").isNull().alias("i")), "key", "i") == [("a", True), ("b", False), ("c", True)]
    assert objects.count() == 1
    loaded = snapshot.load_values(valued, objects)
    assert [(r["key"], len(r["content"]), r["status"]) for r in loaded.orderBy("key").collect()] == [("a", 64, "ok"), ("b", 65, "ok"), ("c", 0, "ok")]
    assert snapshot.load_values(valued, objects.limit(0)).where("status = 'missing'").count() == 1


def test_prefix_lookup(spark):
    objects = spark.createDataFrame([("ab12",), ("ac00",)], "hash string")
    assert [snapshot.find_by_prefix(objects, p).count() for p in ("", "A", "ab", "xy")] == [2, 2, 1, 0]
