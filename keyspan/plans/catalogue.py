"""The library's own queries over the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.functions import paths, scalars
from keyspan.operators import config, fsview, history, instances, maintenance, merge, overlay, setops, snapshot
from keyspan.plans.inputs import (
    GRAPH_SQL, MERGE_TREES_SQL, OBJECTS_SQL, SNAPSHOTS_SQL, TIPS_SQL, TREE_SQL, commit_graph, document_tree, kept_objects, merge_trees, objects, table, three_snapshots, tips)
from keyspan.plans.scratch import shared_dir
from keyspan.schema import stored_value
from keyspan.sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]
#: Epoch seconds of the order date, which has no time zone.
_SECONDS = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)"
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# scans and lookups


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(F.col("url").alias("key"), F.col("page_id").alias("value"))


@query("SELECT o_orderkey AS key, o_orderstatus AS value FROM orders WHERE o_orderkey = 77")
def point_get(spark, sf):
    return snapshot.get(table(spark, sf, "orders").selectExpr("o_orderkey AS key", "o_orderstatus AS value"), 77)


@query("SELECT o_orderkey AS key, o_orderstatus AS value FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def get_many(spark, sf):
    keys = table(spark, sf, "lineitem").where("l_quantity >= 50").selectExpr("l_orderkey AS key")
    return snapshot.get_many(table(spark, sf, "orders").selectExpr("o_orderkey AS key", "o_orderstatus AS value"), keys)


@query("SELECT url AS key, page_id AS value FROM pages ORDER BY url")
def scan_sorted(spark, sf):
    return snapshot.scan(_pages(spark, sf))


@query("SELECT url AS key, page_id AS value FROM pages WHERE starts_with(url, 'https://')")
def prefix_scan(spark, sf):
    return snapshot.scan_prefix(_pages(spark, sf), "https://")


@query("SELECT url AS key, page_id AS value FROM pages WHERE url >= 'http://m' ORDER BY url LIMIT 1")
def seek_first(spark, sf):
    return snapshot.seek(_pages(spark, sf), "http://m")


@query("SELECT o_orderkey AS key, o_orderstatus AS value FROM orders WHERE o_orderkey > 100 ORDER BY 1 LIMIT 25")
def page_after(spark, sf):
    return snapshot.page_after(table(spark, sf, "orders").selectExpr("o_orderkey AS key", "o_orderstatus AS value"), 100, 25)


@query("SELECT count(*) AS n FROM lineitem")
def count_entries(spark, sf):
    return snapshot.count(table(spark, sf, "lineitem"))


@query(f"WITH {OBJECTS_SQL} SELECT hash, n_bytes FROM objects WHERE starts_with(hash, 'a')")
def find_by_prefix(spark, sf):
    return snapshot.find_by_prefix(objects(spark, sf), "A").select("hash", "n_bytes")


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 64 THEN text END AS inline, CASE WHEN octet_length(encode(text)) > 64 THEN sha256(text) END AS external FROM documents")
def inline_vs_external(spark, sf):
    return table(spark, sf, "documents").withColumn("v", stored_value(F.col("text"))).select("doc_id", F.col("v.inline").cast("string").alias("inline"), "v.external")


@query("SELECT doc_id, 'ok' AS status, octet_length(encode(text))::BIGINT AS n_bytes FROM documents")
def load_values(spark, sf):
    rows, big = snapshot.store_values(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return snapshot.load_values(rows, big).select("doc_id", "status", F.octet_length("content").cast("long").alias("n_bytes"))


@query("SELECT doc_id, substr(hex(encode(text)), 21, 40) AS part FROM documents")
def read_range(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.hex(scalars.read_range(F.col("text"), F.lit(10), F.lit(20))).alias("part"))


# builds and changes


@query("""SELECT l_orderkey, l_linenumber, r.l_partkey, r.l_suppkey, r.l_shipdate FROM (SELECT l_orderkey, l_linenumber,
  max({'l_shipdate': l_shipdate, 'l_partkey': l_partkey, 'l_suppkey': l_suppkey}) AS r FROM lineitem GROUP BY 1, 2)""")
def bulk_build_last_wins(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return snapshot.bulk_build(rows, [F.col("l_shipdate"), F.col("l_partkey"), F.col("l_suppkey")], ["l_orderkey", "l_linenumber"])


@query(f"WITH {SNAPSHOTS_SQL} SELECT key, value FROM theirs UNION ALL SELECT key, value FROM base WHERE key NOT IN (SELECT key FROM theirs)")
def put_many(spark, sf):
    base, _, theirs = three_snapshots(spark, sf)
    return snapshot.put_many(base, theirs)


@query(f"WITH {SNAPSHOTS_SQL} SELECT key, value FROM base WHERE key NOT IN (SELECT o_custkey FROM orders)")
def delete_many(spark, sf):
    keys = table(spark, sf, "orders").selectExpr("o_custkey AS key")
    return snapshot.delete_many(three_snapshots(spark, sf)[0], keys)


# set operations and diff

_SIDES = "coalesce(l.key, r.key) AS key"
_JOIN = "FROM base l FULL JOIN ours r ON l.key = r.key"


@query(f"WITH {SNAPSHOTS_SQL} SELECT {_SIDES}, CASE WHEN r.key IS NULL THEN 'left' WHEN l.key IS NULL THEN 'right' WHEN l.value = r.value THEN 'equal' ELSE 'differ' END AS side, l.value AS left_value, r.value AS right_value {_JOIN}")
def outer_walk(spark, sf):
    base, ours, _ = three_snapshots(spark, sf)
    return setops.outer_walk(base, ours)


_DIFF_SQL = f"""SELECT {_SIDES}, CASE WHEN l.key IS NULL THEN 'added' WHEN r.key IS NULL THEN 'removed' ELSE 'modified' END AS change, l.value AS old, r.value AS new
  {_JOIN} WHERE l.key IS NULL OR r.key IS NULL OR l.value <> r.value"""


@query(f"WITH {SNAPSHOTS_SQL} {_DIFF_SQL}")
def diff(spark, sf):
    base, ours, _ = three_snapshots(spark, sf)
    return setops.diff(base, ours)


@query(f"WITH {SNAPSHOTS_SQL} {_DIFF_SQL}")
def diff_pruned(spark, sf):
    """Two stored snapshots: the second is the first with changes to some keys, and buckets with equal digests aren't read."""
    base, ours, _ = three_snapshots(spark, sf)
    store = Store(spark, f"{shared_dir(spark)}/keyspan-{uuid.uuid4().hex}")
    return store.diff(store.write_snapshot(base), store.write_snapshot(ours))


@query("SELECT o_orderkey AS key, 'modified' AS change, o_orderstatus AS old, 'new' AS new FROM orders WHERE o_orderkey IN (SELECT max(o_orderkey) FROM orders GROUP BY o_orderpriority)")
def diff_few_buckets(spark, sf):
    """The diff after a change to one key of each priority: at most five of the stored buckets are read and written."""
    orders = table(spark, sf, "orders")
    store = Store(spark, f"{shared_dir(spark)}/keyspan-{uuid.uuid4().hex}")
    before = store.write_snapshot(orders.selectExpr("o_orderkey AS key", "o_orderstatus AS value"))
    changes = orders.groupBy("o_orderpriority").agg(F.max("o_orderkey").alias("key")).select("key", F.lit("new").alias("value"))
    return store.diff(before, store.apply(before, changes))


@query(f"WITH {SNAPSHOTS_SQL}, d AS ({_DIFF_SQL}) SELECT change, CASE change WHEN 'added' THEN '+' WHEN 'removed' THEN '-' ELSE '~' END AS label, count(*) AS n FROM d GROUP BY 1, 2")
def diff_counts(spark, sf):
    return diff(spark, sf).groupBy("change", merge.change_label(F.col("change")).alias("label")).agg(F.count("*").alias("n"))


@query(f"WITH {SNAPSHOTS_SQL} SELECT key, value FROM base WHERE key NOT IN (SELECT key FROM ours)")
def difference(spark, sf):
    base, ours, _ = three_snapshots(spark, sf)
    return setops.difference(base, ours)


@query(f"WITH {SNAPSHOTS_SQL} SELECT base.key, base.value FROM base JOIN ours ON base.key = ours.key AND base.value = ours.value")
def intersection(spark, sf):
    base, ours, _ = three_snapshots(spark, sf)
    return setops.intersection(base, ours)


@query(f"WITH {SNAPSHOTS_SQL} SELECT key, value FROM base")
def intersection_self(spark, sf):
    base = three_snapshots(spark, sf)[0]
    return setops.intersection(base, base)


@query(f"WITH {SNAPSHOTS_SQL} SELECT {_SIDES}, CASE WHEN r.key IS NULL THEN l.value ELSE r.value END AS value {_JOIN}")
def union_right_wins(spark, sf):
    base, ours, _ = three_snapshots(spark, sf)
    return setops.union(base, ours)


# merge

def _aligned_sql(sides: str) -> str:
    return f"""{sides},
al AS (SELECT k.key, b.key IS NOT NULL AS hb, o.key IS NOT NULL AS ho, t.key IS NOT NULL AS ht, b.value AS b, o.value AS o, t.value AS t
  FROM (SELECT key FROM base UNION SELECT key FROM ours UNION SELECT key FROM theirs) k LEFT JOIN base b ON k.key = b.key LEFT JOIN ours o ON k.key = o.key LEFT JOIN theirs t ON k.key = t.key),
me AS (SELECT *, CASE WHEN o IS NOT DISTINCT FROM t THEN o WHEN b IS NOT DISTINCT FROM o THEN t WHEN b IS NOT DISTINCT FROM t THEN o WHEN NOT ht THEN o ELSE t END AS value,
  CASE WHEN o IS NOT DISTINCT FROM t OR b IS NOT DISTINCT FROM o OR b IS NOT DISTINCT FROM t THEN NULL WHEN NOT hb THEN 'both added' WHEN NOT ho THEN 'delete/modify' WHEN NOT ht THEN 'modify/delete' ELSE 'both modified' END AS conflict FROM al)"""


_MERGE_SQL = _aligned_sql(SNAPSHOTS_SQL)


@query(f"WITH {_MERGE_SQL} SELECT key, value FROM me WHERE value IS NOT NULL")
def merge3(spark, sf):
    return merge.three_way_merge(*three_snapshots(spark, sf))[0]


@query(f"WITH {_MERGE_SQL} SELECT key, conflict, b AS base, o AS ours, t AS theirs, 0 AS conflict_rank FROM me WHERE conflict IS NOT NULL")
def merge3_conflicts(spark, sf):
    return merge.three_way_merge(*three_snapshots(spark, sf))[1]


@query(f"WITH {_MERGE_SQL} SELECT coalesce(conflict, 'clean') AS conflict, count(*) AS n FROM me GROUP BY 1")
def merge3_conflict_counts(spark, sf):
    done = merge.classify(merge.align(*three_snapshots(spark, sf)))
    return done.groupBy(F.coalesce("conflict", F.lit("clean")).alias("conflict")).agg(F.count("*").alias("n"))


_PATHS_SQL = _aligned_sql(MERGE_TREES_SQL) + """,
m AS (SELECT key, value FROM me WHERE value IS NOT NULL), lost AS (SELECT DISTINCT a.key FROM m a JOIN m b ON starts_with(b.key, a.key || '/'))"""


@query(f"WITH {MERGE_TREES_SQL}, m AS (SELECT key FROM ours UNION ALL SELECT key FROM theirs) SELECT key FROM m WHERE EXISTS (SELECT 1 FROM m b WHERE starts_with(b.key, m.key || '/'))")
def file_dir_collisions(spark, sf):
    _, ours, theirs = merge_trees(spark, sf)
    return merge.blocked_files(ours.unionByName(theirs))


@query(f"WITH {_PATHS_SQL} SELECT key, value FROM m WHERE key NOT IN (SELECT key FROM lost)")
def merge_paths(spark, sf):
    return merge.three_way_merge(*merge_trees(spark, sf), paths=True)[0]


@query(f"""WITH {_PATHS_SQL} SELECT key, conflict, b AS base, o AS ours, t AS theirs, 0 AS conflict_rank FROM me WHERE conflict IS NOT NULL
UNION ALL SELECT key, 'file/directory', b, o, t, 1 FROM me WHERE key IN (SELECT key FROM lost)""")
def merge_paths_conflicts(spark, sf):
    return merge.three_way_merge(*merge_trees(spark, sf), paths=True)[1]


@query(f"WITH {MERGE_TREES_SQL} SELECT t.key, o.key AS blocker FROM theirs t JOIN ours o ON starts_with(t.key, o.key || '/')")
def file_ancestor_violations(spark, sf):
    _, ours, theirs = merge_trees(spark, sf)
    return fsview.violations(ours.withColumn("kind", F.lit("file")), theirs)


@query("""SELECT a.doc_id, '<<<<<<< ours' || chr(10) || a.text || CASE WHEN ends_with(a.text, chr(10)) THEN '' ELSE chr(10) END || '=======' || chr(10) || b.text
  || CASE WHEN ends_with(b.text, chr(10)) THEN '' ELSE chr(10) END || '>>>>>>> theirs' || chr(10) AS marked FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1""")
def conflict_markers(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")
    return pairs.select("doc_id", merge.conflict_markers(F.col("text"), F.col("other")).alias("marked"))


# directory view


@query(f"WITH {TREE_SQL} SELECT split_part(key, '/', 1) AS name, 'directory' AS kind FROM entries GROUP BY 1")
def ls_root(spark, sf):
    return fsview.ls(document_tree(spark, sf)).select("name", "kind")


@query(f"WITH {TREE_SQL} SELECT split_part(key, '/', 3) AS name, kind, size, mode, mtime FROM entries WHERE starts_with(key, 'en/src0/')")
def ls_dir(spark, sf):
    return fsview.ls(document_tree(spark, sf), "en/src0").drop("target")


@query(f"WITH {TREE_SQL} SELECT split_part(key, '/', 1) AS path, 1 AS depth, 'directory' AS kind FROM entries GROUP BY 1 UNION ALL SELECT split_part(key, '/', 1) || '/' || split_part(key, '/', 2), 2, 'directory' FROM entries GROUP BY 1")
def tree_depth(spark, sf):
    return fsview.tree(document_tree(spark, sf), depth=2)


@query(f"WITH {TREE_SQL} SELECT count(*) > 0 AS found FROM entries WHERE key = 'de/src1' OR starts_with(key, 'de/src1/')")
def exists(spark, sf):
    return fsview.exists(document_tree(spark, sf), "de/src1")


@query(f"WITH {TREE_SQL} SELECT count(*) > 0 AS found FROM entries WHERE starts_with(key, 'de/src1/')")
def is_dir(spark, sf):
    return fsview.is_dir(document_tree(spark, sf), "de/src1")


@query(f"WITH {TREE_SQL} SELECT key, size FROM entries WHERE NOT starts_with(key, 'en/')")
def rm_subtree(spark, sf):
    return fsview.rm(document_tree(spark, sf), "en").select("key", "size")


@query(f"WITH {TREE_SQL} SELECT key, size FROM entries UNION ALL SELECT 'copy/' || substr(key, 4), size FROM entries WHERE starts_with(key, 'en/')")
def cp_subtree(spark, sf):
    return fsview.cp(document_tree(spark, sf), "en", "copy").select("key", "size")


@query(f"WITH {TREE_SQL} SELECT CASE WHEN starts_with(key, 'en/') THEN 'moved/' || substr(key, 4) ELSE key END AS key, size FROM entries")
def mv_subtree(spark, sf):
    return fsview.mv(document_tree(spark, sf), "en", "moved").select("key", "size")


@query(f"""WITH {TREE_SQL}, p AS (SELECT split_part(key, '/', 1) AS a, split_part(key, '/', 1) || '/' || split_part(key, '/', 2) AS b, size FROM entries)
SELECT '' AS directory, count(DISTINCT a) AS children, count(*) AS files, sum(size)::BIGINT AS bytes FROM p UNION ALL SELECT a, count(DISTINCT b), count(*), sum(size)::BIGINT FROM p GROUP BY a UNION ALL SELECT b, count(*), count(*), sum(size)::BIGINT FROM p GROUP BY b""")
def dir_sizes(spark, sf):
    return fsview.dir_sizes(document_tree(spark, sf))


@query(f"WITH {TREE_SQL} SELECT key FROM entries WHERE NOT starts_with(key, 'fr/') AND split_part(key, '/', 2) <> 'src3'")
def delete_paths(spark, sf):
    entries = document_tree(spark, sf)
    gone = entries.select(F.concat(F.substring_index("key", "/", 1), F.lit("/src3")).alias("key")).distinct().unionByName(spark.range(1).select(F.lit("fr").alias("key")))
    return fsview.delete_paths(entries, gone).select("key")


@query(f"WITH {TREE_SQL} SELECT key, ceil(size / 512)::BIGINT AS blocks FROM entries")
def file_blocks(spark, sf):
    return document_tree(spark, sf).select("key", fsview.blocks(F.col("size")).cast("long").alias("blocks"))


def _members(spark: SparkSession, sf: str) -> DataFrame:
    """Three layers of members from all documents: files, symlinks and directory members in nested directories, then hardlinks and whiteouts of files, directories and contents."""
    docs = table(spark, sf, "documents").selectExpr("doc_id", "(doc_id % 3) * 10000000000 + doc_id AS ord", "concat(lang, '/', source) AS top", "concat(lang, '/', source, '/', doc_id % 4) AS dir", "cast(octet_length(text) AS long) AS size")
    nothing, zero = "cast(NULL AS string) AS link_target", "cast(0 AS long) AS size"
    put = docs.selectExpr("ord", "CASE WHEN doc_id % 13 = 5 THEN concat('./', dir, '/./') ELSE concat('./', dir, '/f', doc_id % 50) END AS path", "CASE WHEN doc_id % 13 = 5 THEN 'directory' WHEN doc_id % 11 = 3 THEN 'symlink' ELSE 'file' END AS kind", "size", nothing)
    marks = docs.where("doc_id % 7 = 0").selectExpr("ord + 3000000000 AS ord", "CASE doc_id % 5 WHEN 0 THEN concat(top, '/.wh.', doc_id % 4) WHEN 1 THEN concat(dir, '/.wh..wh..opq') WHEN 2 THEN concat(top, '/.wh..wh..opq') ELSE concat(dir, '/.wh.f', doc_id % 50) END AS path", "'file' AS kind", zero, nothing)
    links = docs.where("doc_id % 13 <> 5").selectExpr("ord + 1000000000 AS ord", "concat('links/', doc_id) AS path", "'hardlink' AS kind", zero, "concat(dir, '/f', doc_id % 50) AS link_target").where("ord < 10000000000")
    return put.unionByName(marks).unionByName(links)


_LAYERS_SQL = """d AS (SELECT doc_id, (doc_id % 3) * 10000000000 + doc_id AS ord, lang || '/' || source AS top, lang || '/' || source || '/' || (doc_id % 4) AS dir, octet_length(encode(text))::BIGINT AS size FROM documents),
puts AS (SELECT ord, CASE WHEN doc_id % 13 = 5 THEN dir ELSE dir || '/f' || (doc_id % 50) END AS key, CASE WHEN doc_id % 13 = 5 THEN 'directory' WHEN doc_id % 11 = 3 THEN 'symlink' ELSE 'file' END AS kind, size FROM d),
marks AS (SELECT ord + 3000000000 AS ord, CASE doc_id % 5 WHEN 0 THEN top || '/' || (doc_id % 4) WHEN 1 THEN dir WHEN 2 THEN top ELSE dir || '/f' || (doc_id % 50) END AS at, doc_id % 5 NOT IN (1, 2) AS own FROM d WHERE doc_id % 7 = 0),
linked AS (SELECT d.ord + 1000000000 AS ord, 'links/' || d.doc_id AS key, max_by(p.kind, p.ord) AS kind, max_by(p.size, p.ord) AS size FROM d JOIN puts p ON p.key = d.dir || '/f' || (d.doc_id % 50) AND p.ord < d.ord + 1000000000
  WHERE d.doc_id % 13 <> 5 AND d.doc_id % 3 = 0 GROUP BY d.doc_id, d.ord),
every AS (SELECT * FROM puts UNION ALL SELECT * FROM linked),
hits AS (SELECT p.key, p.ord, min(m.ord) AS c FROM every p JOIN marks m ON m.ord > p.ord AND (starts_with(p.key, m.at || '/') OR p.key = m.at AND m.own) GROUP BY 1, 2),
remade AS (SELECT DISTINCT m.ord, m.at AS key, 'directory' AS kind, NULL::BIGINT AS size FROM marks m JOIN hits h ON h.c = m.ord WHERE NOT m.own),
l AS (SELECT * FROM (SELECT * FROM every UNION ALL SELECT * FROM remade) QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord DESC) = 1)"""


@query(f"WITH {_LAYERS_SQL} SELECT key, kind, size FROM l WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.ord > l.ord AND (starts_with(l.key, m.at || '/') OR l.key = m.at AND m.own))")
def overlay_layers(spark, sf):
    return overlay.apply_layers(_members(spark, sf))


@query(f"WITH {_LAYERS_SQL} SELECT key, ord AS opaque_ord FROM remade WHERE key NOT IN (SELECT dir FROM d)")
def overlay_opaque(spark, sf):
    """The top directories that opaque whiteouts empty, at each of these whiteouts."""
    members = _members(spark, sf)
    return overlay.emptied_directories(members).where(F.size(F.split("key", "/")) == 2).select("key", F.col("ord").alias("opaque_ord"))


# content


@query("SELECT sha256(text) AS hash, count(*) AS copies, any_value(octet_length(encode(text)))::BIGINT AS n_bytes FROM documents GROUP BY 1")
def content_dedup(spark, sf):
    return maintenance.dedup(table(spark, sf, "documents"), "text")


@query("SELECT count(*) AS contents, sum(copies)::BIGINT AS copies, sum(n_bytes)::BIGINT AS stored, sum(n_bytes * copies)::BIGINT AS logical FROM (SELECT count(*) AS copies, any_value(octet_length(encode(text)))::BIGINT AS n_bytes FROM documents GROUP BY sha256(text))")
def dedup_ratio(spark, sf):
    return content_dedup(spark, sf).agg(F.count("*").alias("contents"), F.sum("copies").alias("copies"), F.sum("n_bytes").alias("stored"), F.sum(F.col("n_bytes") * F.col("copies")).alias("logical"))


# history


@query(f"WITH RECURSIVE {GRAPH_SQL}, {TIPS_SQL} SELECT event_id::VARCHAR AS hash, user_id::VARCHAR AS author, event_type AS message, epoch_us(ts) AS ts, row_number() OVER (ORDER BY ts DESC) - 1 AS position FROM f WHERE event_id IN (SELECT h FROM up WHERE side = 'a')")
def commit_log(spark, sf):
    return history.log(commit_graph(spark, sf), tips(spark, sf)[0]).select("hash", "author", "message", "ts", "position")


@query(f"WITH RECURSIVE {GRAPH_SQL}, {TIPS_SQL} SELECT h::VARCHAR AS hash FROM up WHERE side = 'a'")
def ancestors(spark, sf):
    return history.ancestors(commit_graph(spark, sf), tips(spark, sf)[0]).select("hash")


@query(f"""WITH RECURSIVE {GRAPH_SQL}, {TIPS_SQL}, c AS (SELECT h FROM up WHERE side = 'a' INTERSECT SELECT h FROM up WHERE side = 'b')
SELECT event_id::VARCHAR AS hash, epoch_us(ts) AS ts FROM f WHERE event_id IN (SELECT h FROM c) AND event_id NOT IN (SELECT p FROM edges WHERE h IN (SELECT h FROM c)) ORDER BY f.ts DESC, hash DESC LIMIT 1""")
def merge_base(spark, sf):
    return history.merge_base(commit_graph(spark, sf), *tips(spark, sf))


@query(f"WITH RECURSIVE {GRAPH_SQL}, {TIPS_SQL} SELECT (SELECT b FROM tips)::VARCHAR AS old, (SELECT a FROM tips)::VARCHAR AS new, (SELECT count(*) FROM up WHERE side = 'a' AND h = (SELECT b FROM tips)) > 0 AS fast_forward")
def is_fast_forward(spark, sf):
    new, old = tips(spark, sf)
    return spark.createDataFrame([(old, new, history.is_ancestor(commit_graph(spark, sf), old, new))], "old string, new string, fast_forward boolean")


@query(f"""WITH RECURSIVE {GRAPH_SQL}, {TIPS_SQL}, r AS (SELECT h FROM up WHERE side = 'a') SELECT h::VARCHAR AS hash, 'commit' AS kind FROM r
UNION SELECT 'o' || c_custkey, 'blob' FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_id IN (SELECT h FROM r))""")
def reachable(spark, sf):
    held = table(spark, sf, "customer").selectExpr("cast(c_custkey AS string) AS tree", "concat('o', c_custkey) AS hash", "'blob' AS kind")
    return history.reachable(commit_graph(spark, sf), [tips(spark, sf)[0]], held)


# maintenance


@query(f"WITH {OBJECTS_SQL} SELECT count(*) AS total, count(k.hash) AS reachable, count(*) - count(k.hash) AS deleted, coalesce(sum(CASE WHEN k.hash IS NULL THEN n_bytes END), 0)::BIGINT AS bytes_freed FROM objects o LEFT JOIN kept k ON o.hash = k.hash")
def gc_report(spark, sf):
    return maintenance.gc_report(objects(spark, sf), kept_objects(spark, sf))


@query(f"WITH {OBJECTS_SQL} SELECT hash, n_bytes FROM objects WHERE hash NOT IN (SELECT hash FROM kept)")
def gc_sweep(spark, sf):
    return maintenance.garbage(objects(spark, sf), kept_objects(spark, sf)).select("hash", "n_bytes")


def _damaged(spark: SparkSession, sf: str) -> DataFrame:
    rows = objects(spark, sf).where(~F.col("hash").startswith("0"))
    return rows.withColumn("bytes", F.when(F.col("hash").startswith("1"), F.concat("bytes", F.lit("x").cast("binary"))).otherwise(F.col("bytes")))


@query(f"WITH {OBJECTS_SQL} SELECT hash, CASE WHEN starts_with(hash, '0') THEN 'missing' ELSE 'corrupt' END AS problem FROM kept WHERE starts_with(hash, '0') OR starts_with(hash, '1')")
def fsck_problems(spark, sf):
    return maintenance.fsck(kept_objects(spark, sf), _damaged(spark, sf))


@query(f"WITH {OBJECTS_SQL} SELECT count(*) AS checked, count(*) FILTER (starts_with(hash, '0')) AS missing, count(*) FILTER (starts_with(hash, '1')) AS corrupt FROM kept")
def fsck_report(spark, sf):
    return maintenance.fsck_report(kept_objects(spark, sf), _damaged(spark, sf))


@query(f"WITH {OBJECTS_SQL} SELECT hash, n_bytes FROM objects WHERE hash IN (SELECT hash FROM kept) AND NOT starts_with(hash, 'a')")
def have_want_missing(spark, sf):
    here = objects(spark, sf)
    return maintenance.transfer(kept_objects(spark, sf), here, here.where(F.col("hash").startswith("a"))).select("hash", "n_bytes")


@query(f"WITH {OBJECTS_SQL} SELECT hash, n_bytes FROM objects WHERE hash IN (SELECT hash FROM kept)")
def closure_export(spark, sf):
    return maintenance.export_closure(kept_objects(spark, sf), objects(spark, sf)).select("hash", "n_bytes")


@query(f"""WITH RECURSIVE {OBJECTS_SQL}, o AS (SELECT substr(hash, 1, 1) AS peer, hash, n_bytes, row_number() OVER (PARTITION BY substr(hash, 1, 1) ORDER BY hash) AS i FROM objects),
r AS (SELECT peer, hash, n_bytes, i, 0 AS batch, n_bytes AS held FROM o WHERE i = 1 UNION ALL SELECT o.peer, o.hash, o.n_bytes, o.i, CASE WHEN r.held + o.n_bytes > 524288 THEN r.batch + 1 ELSE r.batch END,
  CASE WHEN r.held + o.n_bytes > 524288 THEN o.n_bytes ELSE r.held + o.n_bytes END FROM r JOIN o ON o.peer = r.peer AND o.i = r.i + 1)
SELECT peer, hash, n_bytes, batch FROM r""")
def send_batches(spark, sf):
    return maintenance.send_batches(objects(spark, sf).withColumn("peer", F.substring("hash", 1, 1)))


# scalars and paths


@query(r"""SELECT page_id, CASE WHEN list_contains(s, '..') THEN NULL ELSE array_to_string(s, '/') END AS path FROM (SELECT page_id, [x FOR x IN string_split(regexp_replace(url, '^[a-z]+://', './'), '/') IF x <> '' AND x <> '.'] AS s FROM pages)""")
def normalize_path(spark, sf):
    return table(spark, sf, "pages").select("page_id", paths.normalize_path(F.regexp_replace("url", "^[a-z]+://", "./")).alias("path"))


@query(r"SELECT page_id, '/' || array_to_string([x FOR x IN string_split(regexp_replace(url, '^[a-z]+://', ''), '/') IF x <> '' AND x <> '.'], '/') || '/x' AS path FROM pages")
def collapse_dotdot(spark, sf):
    rest = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, sf, "pages").select("page_id", paths.collapse_dotdot(F.concat(F.lit("../"), rest, F.lit("/a/./b/../..//x"))).alias("path"))


@query(r"SELECT page_id, regexp_extract(url, '^([^:/]+):', 1) AS ref, regexp_replace(url, '^[^:/]+:', '') AS path FROM pages")
def split_ref(spark, sf):
    return table(spark, sf, "pages").withColumn("s", paths.split_ref(F.col("url"))).select("page_id", "s.ref", "s.path")


@query(f"WITH {TREE_SQL} SELECT key, regexp_extract(key, '^(.*)/', 1) AS parent, regexp_extract(key, '([^/]*)$', 1) AS name FROM entries")
def parent_name(spark, sf):
    return document_tree(spark, sf).select("key", paths.parent_of(F.col("key")).alias("parent"), paths.name_of(F.col("key")).alias("name"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'container' WHEN 1 THEN 'workspace' WHEN 2 THEN 'peers' ELSE 'local' END AS target, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment END AS name,
  CASE c_custkey % 4 WHEN 0 THEN 'a/' || c_name WHEN 1 THEN c_name WHEN 2 THEN c_name ELSE 'etc/' || c_name END AS path FROM customer""")
def route(spark, sf):
    raw = F.expr("CASE c_custkey % 4 WHEN 0 THEN concat('/containers/', c_mktsegment, '/a/', c_name) WHEN 1 THEN concat('/workspace/', c_name) WHEN 2 THEN concat('peers/', c_name) ELSE concat('//etc/', c_name) END")
    return table(spark, sf, "customer").withColumn("r", paths.route(raw)).select("c_custkey", "r.target", "r.name", "r.path")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S UTC') AS at FROM orders")
def format_ts(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", scalars.format_ts(F.expr(_SECONDS)).alias("at"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1024 WHEN 2 THEN p_size * 1048576 WHEN 3 THEN p_size::BIGINT * 1073741824 END::BIGINT AS bytes FROM part")
def parse_size(spark, sf):
    text = F.concat(F.col("p_size").cast("string"), F.expr("CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'k' WHEN 2 THEN ' M' WHEN 3 THEN 'G' ELSE 'x' END"))
    return table(spark, sf, "part").select("p_partkey", scalars.parse_size(text).alias("bytes"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'host.io:5000' ELSE 'registry-1.docker.io' END AS registry, CASE s_suppkey % 3 WHEN 1 THEN 'library/' || lower(split_part(s_name, '#', 1)) ELSE 'team/' || lower(split_part(s_name, '#', 1)) END AS repo,
  CASE s_suppkey % 2 WHEN 0 THEN 'v' || s_nationkey ELSE 'latest' END AS reference FROM supplier""")
def image_ref(spark, sf):
    name = F.lower(F.substring_index("s_name", "#", 1))
    text = F.concat(F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'host.io:5000/team/' WHEN 1 THEN '' ELSE 'team/' END"), name, F.expr("CASE s_suppkey % 2 WHEN 0 THEN concat(':v', s_nationkey) ELSE '' END"))
    return table(spark, sf, "supplier").withColumn("r", scalars.image_ref(text)).select("s_suppkey", "r.registry", "r.repo", "r.reference")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 < 3 THEN '/data/' || n_name END AS host, CASE WHEN n_nationkey % 4 < 3 THEN '/mnt' END AS container, CASE WHEN n_nationkey % 4 < 3 THEN n_nationkey % 4 = 1 END AS readonly FROM nation")
def volume_spec(spark, sf):
    text = F.concat(F.lit("/data/"), "n_name", F.expr("CASE n_nationkey % 4 WHEN 0 THEN ':/mnt' WHEN 1 THEN ':/mnt:ro' WHEN 2 THEN ':/mnt:rw' ELSE ':mnt' END"))
    return table(spark, sf, "nation").withColumn("v", scalars.volume_spec(text)).select("n_nationkey", "v.host", "v.container", "v.readonly")


@query("SELECT c_custkey, c_custkey % 4 = 3 AS valid FROM customer")
def branch_name_valid(spark, sf):
    text = F.concat(F.expr("CASE c_custkey % 4 WHEN 0 THEN '-' WHEN 1 THEN '.' WHEN 2 THEN 'a/' ELSE '' END"), "c_mktsegment")
    return table(spark, sf, "customer").select("c_custkey", scalars.valid_name(text).alias("valid"))


@query("""SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 40 THEN text ELSE substr(text, 1, list_max([i FOR i IN range(0, 40) IF octet_length(encode(substr(text, 1, i))) <= 39])) || '…' END AS short FROM documents""")
def truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", scalars.truncate(F.col("text"), 40).alias("short"))


@query("SELECT doc_id, doc_id % 2 = 0 AS valid FROM documents")
def verify_digest(spark, sf):
    claim = F.concat(F.lit("sha256:"), F.upper(F.sha2(F.concat("text", F.when(F.col("doc_id") % 2 == 0, "").otherwise("!")).cast("binary"), 256)))
    return table(spark, sf, "documents").select("doc_id", scalars.verify_digest(F.col("text"), claim).alias("valid"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN false WHEN 1 THEN o_custkey % 4 <> 0 ELSE true END AS restart FROM orders")
def restart_table(spark, sf):
    policy = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'no' WHEN 1 THEN 'on-failure' ELSE 'always' END")
    return table(spark, sf, "orders").select("o_orderkey", scalars.wants_restart(policy, F.col("o_custkey") % 4).alias("restart"))


@query("SELECT conv_id, turn, CASE role WHEN 'system' THEN 3 WHEN 'assistant' THEN 2 WHEN 'user' THEN 1 ELSE 0 END >= 2 AS allowed FROM conversations")
def role_gate(spark, sf):
    role = F.expr("CASE role WHEN 'system' THEN 'deploy' WHEN 'assistant' THEN 'sync' WHEN 'user' THEN 'read' END")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(scalars.role_allows(role, F.lit("sync")), F.lit(False)).alias("allowed"))


# configuration


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN n_name END, c_mktsegment) AS image, coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_name END, 'none') AS network FROM customer JOIN nation ON c_nationkey = n_nationkey")
def profile_overlay(spark, sf):
    rows = table(spark, sf, "customer")
    base = rows.select("c_custkey", F.col("c_mktsegment").alias("image"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("network"))
    profile = rows.where("c_custkey % 3 = 0").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("image"))
    return config.overlay(base, profile, ["c_custkey"], {"network": "none"})


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'override' ELSE 'base' END AS a, n_name AS b, CASE WHEN n_nationkey % 2 = 0 THEN 'extra' END AS c FROM nation")
def merged_env(spark, sf):
    base = F.create_map(F.lit("a"), F.lit("base"), F.lit("b"), F.col("n_name"))
    over = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("a"), F.lit("override"), F.lit("c"), F.lit("extra")))
    return table(spark, sf, "nation").withColumn("e", config.merged_env(base, over)).select("n_nationkey", *[F.try_element_at("e", F.lit(k)).alias(k) for k in "abc"])


@query("SELECT min(event_id) AS position, event_type || user_id AS step, sha256(event_type || user_id) AS hash FROM events WHERE event_type || user_id NOT IN (SELECT event_type || user_id FROM events WHERE event_id % 50 = 0) GROUP BY 2")
def applied_steps(spark, sf):
    steps = table(spark, sf, "events").select(F.col("event_id").alias("position"), F.concat("event_type", F.col("user_id").cast("string")).alias("step"))
    done = steps.where("position % 50 = 0").select(F.sha2(F.col("step").cast("binary"), 256).alias("hash")).distinct()
    return config.pending_steps(steps, done)


# instances


def _instances(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "orders").selectExpr(
        "cast(o_orderkey AS string) AS id", "concat('c', o_custkey % 10) AS container", "o_orderpriority AS branch", f"{_SECONDS} AS started_unix", "cast(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey END AS int) AS pid",
        "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5 END AS start", "cast(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4 END AS int) AS exit_code", "0 AS restarts")
    alive = table(spark, sf, "orders").where("o_orderkey % 3 <> 1").selectExpr("cast(o_orderkey AS int) AS pid", "CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 4 END AS start")
    return rows, alive


_RUNNING = "o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 1 AND (o_orderkey % 2 <> 0 OR (o_orderkey % 11 <> 0 AND o_orderkey % 5 = o_orderkey % 4))"
_STATUS = f"CASE WHEN {_RUNNING} THEN 'running (pid ' || o_orderkey || ')' WHEN o_orderkey % 3 = 0 THEN 'exited (' || o_orderkey % 4 || ')' WHEN o_orderkey % 7 <> 0 THEN 'dead' ELSE 'spawning' END AS status"


@query(f"SELECT o_orderkey::VARCHAR AS id, 'c' || o_custkey % 10 AS container, o_orderpriority AS branch, {_STATUS}, 0 AS restarts, epoch(o_orderdate)::BIGINT AS started_unix FROM orders WHERE {_RUNNING}")
def ps_listing(spark, sf):
    return instances.ps(*_instances(spark, sf))


@query(f"SELECT o_orderkey::VARCHAR AS id, {_STATUS} FROM orders")
def instance_status(spark, sf):
    return instances.ps(*_instances(spark, sf), everything=True).select("id", "status")


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr("cast(user_id AS string) AS id", "event_id AS attempt", "cast(event_id * 7 % 90 AS double) AS up_seconds", "cast(event_id % 40 AS int) AS exit_code", "'on-failure' AS policy")


@query("""WITH e AS (SELECT user_id::VARCHAR AS id, event_id AS attempt, event_id * 7 % 90 >= 60 AS ok, event_id % 40 = 0 AS stop FROM events),
l AS (SELECT * FROM (SELECT *, coalesce(max(stop::INT) OVER (PARTITION BY id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e) WHERE before = 0),
s AS (SELECT *, sum(ok::INT) OVER (PARTITION BY id ORDER BY attempt) AS span FROM l)
SELECT id, attempt, CASE WHEN NOT stop THEN least(60, pow(2, least(6, row_number() OVER (PARTITION BY id, span ORDER BY attempt) - 1)))::INTEGER END AS wait, sum((NOT stop)::INT) OVER (PARTITION BY id ORDER BY attempt)::INTEGER AS restarts FROM s""")
def restart_backoff(spark, sf):
    return instances.backoff(_attempts(spark, sf))


@query("""SELECT id, up >= 10 AS healthy FROM (SELECT user_id::VARCHAR AS id, arg_min((event_id * 7 % 90)::DOUBLE, event_id) AS up FROM events GROUP BY 1)""")
def health_gate(spark, sf):
    return instances.healthy(_attempts(spark, sf))
