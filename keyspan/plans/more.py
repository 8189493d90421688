"""Further queries of the library's own operators: files, names, commands, peers, stored objects. Registered with the catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.functions import paths, scalars
from keyspan.operators import config, fsview, history, instances, merge, snapshot
from keyspan.plans.catalogue import _RUNNING, _STATUS, _instances, query
from keyspan.plans.inputs import GRAPH_SQL, OBJECTS_SQL, TREE_SQL, commit_graph, document_tree, objects, table
from keyspan.plans.scratch import shared_dir
from keyspan.schema import content_hash
from keyspan.sources.store import Store

# files of a tree

_FIRST = "concat_ws('/', lang, source, doc_id::VARCHAR)"


def _a_file(spark: SparkSession, sf: str) -> str:
    """The path of document 0."""
    return table(spark, sf, "documents").where("doc_id = 0").select(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))).first()[0]


@query(f"SELECT {_FIRST} AS path, 'ok' AS status, sha256(text) AS hash FROM documents WHERE doc_id = 0")
def read_file(spark, sf):
    return fsview.read_file(document_tree(spark, sf), objects(spark, sf), _a_file(spark, sf)).select("path", "status", content_hash(F.col("bytes")).alias("hash"))


@query(f"SELECT {_FIRST} AS path, 'ok' AS status, substr(hex(encode(text)), 15, 60) AS part FROM documents WHERE doc_id = 0")
def read_file_range(spark, sf):
    return fsview.read_file_range(document_tree(spark, sf), objects(spark, sf), _a_file(spark, sf), 7, 30).select("path", "status", F.hex("bytes").alias("part"))


@query(f"WITH {TREE_SQL} SELECT (SELECT count(*) > 0 FROM entries WHERE key = (SELECT {_FIRST} FROM documents WHERE doc_id = 0)) AS found")
def is_file(spark, sf):
    return fsview.is_file(document_tree(spark, sf), _a_file(spark, sf))


def _links(spark: SparkSession, sf: str) -> DataFrame:
    """The document tree and a symlink for each customer."""
    entries = document_tree(spark, sf)
    kind = F.lit("symlink").alias("kind")
    rows = table(spark, sf, "customer").select(F.concat(F.lit("links/"), F.col("c_custkey").cast("string")).alias("key"), kind, F.lit(0).cast("long").alias("size"), F.lit(0o777).alias("mode"), F.lit(0).cast("long").alias("mtime"), F.col("c_name").alias("target"), F.lit(None).cast("string").alias("content_hash"))
    return entries.unionByName(rows)


@query("SELECT 'links/7' AS path, c_name AS target FROM customer WHERE c_custkey = 7")
def read_symlink(spark, sf):
    return fsview.read_symlink(_links(spark, sf), "links/7")


@query("SELECT count(*) > 0 AS found FROM customer WHERE c_custkey = 7")
def is_symlink(spark, sf):
    return fsview.is_symlink(_links(spark, sf), "links/7")


@query(f"WITH {TREE_SQL} SELECT key, kind, size FROM entries UNION ALL SELECT 'new/' || c_custkey, 'symlink', 0 FROM customer")
def write_files(spark, sf):
    new = _links(spark, sf).where("kind = 'symlink'").withColumn("key", F.regexp_replace("key", "^links/", "new/"))
    return fsview.write_files(document_tree(spark, sf), new).select("key", "kind", "size")


@query(f"WITH {TREE_SQL} SELECT key, kind FROM entries UNION ALL SELECT 'made', 'directory'")
def mkdir(spark, sf):
    return fsview.mkdir(document_tree(spark, sf), "made").select("key", "kind")


@query(f"WITH {TREE_SQL} SELECT 'links/' || c_custkey AS key FROM customer UNION ALL SELECT key FROM entries UNION ALL SELECT 'from/' || substr(key, 4) FROM entries WHERE starts_with(key, 'en/')")
def cp_between_trees(spark, sf):
    """A subtree of one tree copied into another."""
    return fsview.cp(document_tree(spark, sf), "en", "from", into=_links(spark, sf)).select("key")


@query(f"WITH {OBJECTS_SQL} SELECT hash, 'ok' AS status, n_bytes FROM objects UNION ALL SELECT sha256('nowhere' || r_name), 'missing', NULL FROM region")
def store_objects(spark, sf):
    """All texts put into a store, and read back with their addresses verified, beside some that aren't there."""
    store = Store(spark, f"{shared_dir(spark)}/keyspan-{uuid.uuid4().hex}")
    named = store.put(table(spark, sf, "documents").select("text"), "text")
    lost = table(spark, sf, "region").select(content_hash(F.concat(F.lit("nowhere"), "r_name")).alias("hash"))
    return store.read(named.select("hash").unionByName(lost)).select("hash", "status", F.octet_length("bytes").cast("long").alias("n_bytes"))


@query("SELECT 'main' AS container, CASE WHEN r_regionkey % 2 = 0 THEN 'branch' ELSE 'tag' END AS kind, lower(r_name) AS name, sha256(r_name) AS commit FROM region")
def store_refs(spark, sf):
    store = Store(spark, f"{shared_dir(spark)}/keyspan-{uuid.uuid4().hex}")
    rows = table(spark, sf, "region").selectExpr("concat(CASE WHEN r_regionkey % 2 = 0 THEN 'branch/' ELSE 'tag/' END, lower(r_name)) AS k", "sha2(r_name, 256) AS v").collect()  # five
    store.set_refs({r["k"]: (r["v"], None) for r in rows})
    return store.refs_frame()


# bytes


@query("SELECT c_custkey, hex(encode(CASE WHEN length(c_name) >= 3 + length(c_mktsegment) THEN substr(c_name, 1, 3) || c_mktsegment || substr(c_name, 4 + length(c_mktsegment)) ELSE substr(c_name, 1, 3) || c_mktsegment END)) AS bytes FROM customer")
def splice(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.hex(scalars.splice(F.col("c_name"), F.lit(3), F.col("c_mktsegment"))).alias("bytes"))


@query("SELECT c_custkey, substr(rpad(hex(encode(c_mktsegment)), 40, '0'), 1, (2 * (c_custkey % 20))::INTEGER) AS bytes FROM customer")
def resize(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.hex(scalars.resize(F.col("c_mktsegment"), (F.col("c_custkey") % 20).cast("int"))).alias("bytes"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'gzip' WHEN 1 THEN 'zstd' ELSE 'raw' END AS compression FROM documents")
def compression(spark, sf):
    head = F.expr("CASE doc_id % 3 WHEN 0 THEN X'1F8B' WHEN 1 THEN X'28B52FFD' ELSE X'' END")
    return table(spark, sf, "documents").select("doc_id", scalars.compression(F.concat(head, F.col("text").cast("binary"))).alias("compression"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(sha256(text)) END AS hex FROM documents")
def hash_bytes(spark, sf):
    text = F.when(F.col("doc_id") % 2 == 0, F.upper(content_hash(F.col("text")))).otherwise(F.concat(content_hash(F.col("text")), F.lit("0")))
    return table(spark, sf, "documents").select("doc_id", F.hex(scalars.hash_bytes(text)).alias("hex"))


# names and paths


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '/etc' WHEN 1 THEN '/home/' || c_name ELSE '/home' END AS path FROM customer")
def apply_cwd(spark, sf):
    argument = F.expr("CASE c_custkey % 3 WHEN 0 THEN '/etc' WHEN 1 THEN c_name ELSE '' END")
    return table(spark, sf, "customer").select("c_custkey", paths.apply_cwd(F.lit("/home/"), argument).alias("path"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '/' WHEN 1 THEN '/home/a/' || c_name ELSE '/' || c_name END AS path FROM customer")
def resolve_cd(spark, sf):
    argument = F.expr("CASE c_custkey % 3 WHEN 0 THEN '../../..' WHEN 1 THEN concat('./b/../', c_name) ELSE concat('/x/../', c_name) END")
    return table(spark, sf, "customer").select("c_custkey", paths.resolve_cd(F.lit("/home/a"), argument).alias("path"))


@query(f"WITH {TREE_SQL} SELECT key, CASE WHEN starts_with(key, 'en/') THEN substr(key, 4) END AS rest FROM entries")
def strip_mount(spark, sf):
    return document_tree(spark, sf).select("key", paths.strip_mount(F.col("key"), "en").alias("rest"))


@query("SELECT s_suppkey, lower(split_part(s_name, '#', 1)) AS name FROM supplier")
def image_name(spark, sf):
    text = F.concat(F.lit("host.io:5000/team/"), F.lower(F.substring_index("s_name", "#", 1)), F.lit(":v1"))
    return table(spark, sf, "supplier").select("s_suppkey", scalars.image_name(text).alias("name"))


@query("SELECT c_custkey, regexp_full_match(c_mktsegment, '[0-9a-fA-F]+') OR c_custkey % 2 = 0 AS is_hex FROM customer")
def is_hex_prefix(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", scalars.is_hex_prefix(F.when(F.col("c_custkey") % 2 == 0, F.hex("c_custkey")).otherwise(F.col("c_mktsegment"))).alias("is_hex"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'user' END AS author FROM customer")
def author(spark, sf):
    flag, environment = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(""), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", scalars.author(flag, environment).alias("author"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'run ' || c_name ELSE '/bin/sh -c ' || c_name END AS argv FROM customer")
def argv(spark, sf):
    words = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("run"), F.col("c_name")))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(scalars.argv(F.col("c_name"), words), " ").alias("argv"))


@query("SELECT event_id, event_type AS verb, 'u' || user_id || ' now' AS argument FROM events")
def control_verb(spark, sf):
    line = F.concat(F.lit(" "), "event_type", F.lit("  u"), F.col("user_id").cast("string"), F.lit(" now "))
    return table(spark, sf, "events").withColumn("c", scalars.control_verb(line)).select("event_id", "c.verb", "c.argument")


# configuration, instances, peers


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'image is required' WHEN c_custkey % 4 = 1 THEN 'run is empty' ELSE 'run has a blank word' END AS problem FROM customer WHERE c_custkey % 4 <> 3")
def config_problems(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("image"), F.expr("CASE c_custkey % 4 WHEN 1 THEN cast(array() AS array<string>) WHEN 2 THEN array('a', ' ') ELSE array(c_name) END").alias("run"))
    return config.problems(rows).select("c_custkey", "problem")


@query("SELECT 'c' || max(event_id) AS container, '/' || arg_max(event_type, event_id) AS cwd FROM events")
def parse_session(spark, sf):
    lines = table(spark, sf, "events").select(F.col("event_id").alias("position"), F.explode(F.array(F.concat(F.lit("container=c"), F.col("event_id").cast("string")), F.concat(F.lit(" cwd=/"), "event_type"), F.lit("# cwd=/no"), F.lit(""))).alias("value"))
    return config.parse_session(lines)


@query(f"SELECT o_orderkey::VARCHAR AS id, 'c' || o_custkey % 10 AS container, o_orderpriority AS branch, {_STATUS}, 0 AS restarts, epoch(o_orderdate)::BIGINT AS started_unix FROM orders WHERE {_RUNNING}")
def ps_newest_first(spark, sf):
    return instances.listed(instances.ps(*_instances(spark, sf)))


@query("SELECT o_orderkey::VARCHAR AS id FROM orders WHERE o_custkey % 10 = 3 AND o_orderpriority = '1-URGENT'")
def deploy_matches(spark, sf):
    return instances.deploy_matches(_instances(spark, sf)[0], "c3", "1-URGENT").select("id")


@query("SELECT max(length(c_name))::INTEGER AS c_name, max(length(c_mktsegment))::INTEGER AS c_mktsegment, max(length(c_custkey::VARCHAR))::INTEGER AS c_custkey FROM customer")
def column_widths(spark, sf):
    return instances.column_widths(table(spark, sf, "customer").select("c_name", "c_mktsegment", "c_custkey"))


@query("SELECT event_id AS pid FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def in_namespace(spark, sf):
    boxes = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").selectExpr("c_custkey AS ns")
    return instances.in_namespace(table(spark, sf, "events").selectExpr("event_id AS pid", "user_id AS ns"), boxes)


@query("SELECT 'k' || c_custkey AS pubkey, CASE c_custkey % 5 WHEN 0 THEN 'read' WHEN 1 THEN 'sync' WHEN 2 THEN 'deploy' END AS role FROM customer")
def role_of_keys(spark, sf):
    rows = table(spark, sf, "customer")
    peers = rows.selectExpr("c_name AS name", "'h:1' AS address", "concat('k', c_custkey) AS pubkey", "CASE c_custkey % 5 WHEN 0 THEN 'read' WHEN 1 THEN 'sync' WHEN 2 THEN 'deploy' ELSE 'root' END AS role").where("c_custkey % 5 <> 4")
    return instances.role_of(peers, rows.selectExpr("concat('k', c_custkey) AS pubkey"))


@query("SELECT c_name AS container, c_name || ' on ' || CASE WHEN c_custkey % 4 = 0 THEN '(detached)' ELSE c_mktsegment END || ' at ' || CASE WHEN c_custkey % 3 = 0 THEN 'no commits' ELSE substr(sha256(c_name), 1, 12) END || ', ' || CASE WHEN c_custkey % 2 = 0 THEN 'modified' ELSE 'clean' END AS status FROM customer")
def container_status(spark, sf):
    rows = table(spark, sf, "customer").selectExpr("c_name AS container", "CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS branch", "CASE WHEN c_custkey % 3 <> 0 THEN sha2(c_name, 256) END AS head", "c_custkey % 2 = 0 AS changed")
    return instances.container_status(rows)


# history and merges


@query(f"WITH {GRAPH_SQL} SELECT sha256(event_id::VARCHAR) AS hash FROM f WHERE event_id = 7")
def resolve_prefix(spark, sf):
    """A commit by the first digits of its hash."""
    commits = commit_graph(spark, sf).withColumn("hash", F.sha2("hash", 256))
    wanted = table(spark, sf, "events").where("event_id = 7").select(F.sha2(F.col("event_id").cast("string"), 256)).first()[0]
    refs = spark.createDataFrame([("main", "branch", "main", wanted)], "container string, kind string, name string, commit string")
    return spark.createDataFrame([(history.resolve(commits, refs, wanted[:16].upper()),)], "hash string")


@query("""SELECT a.doc_id AS key, a.text AS ours_text, b.text AS theirs_text, '<<<<<<< ours' || chr(10) || a.text || CASE WHEN ends_with(a.text, chr(10)) THEN '' ELSE chr(10) END || '=======' || chr(10) || b.text
  || CASE WHEN ends_with(b.text, chr(10)) THEN '' ELSE chr(10) END || '>>>>>>> theirs' || chr(10) AS marked FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.text <> b.text""")
def content_conflicts(spark, sf):
    """Every document against its successor as both-modified contents of an object table."""
    docs = table(spark, sf, "documents").select("doc_id", content_hash(F.col("text")).alias("hash"))
    both = docs.selectExpr("doc_id AS key", "hash AS o").join(docs.selectExpr("doc_id - 1 AS key", "hash AS t"), "key")
    sides = [both.select("key", F.lit("base").alias("value")), both.select("key", F.col("o").alias("value")), both.select("key", F.col("t").alias("value"))]
    return merge.content_conflicts(merge.three_way_merge(*sides)[1], objects(spark, sf))


@query("SELECT doc_id FROM documents WHERE octet_length(encode(text)) > 64")
def stored_outside(spark, sf):
    """Rows whose content must be fetched: what a reader of inline values alone has to refuse."""
    rows, _ = snapshot.store_values(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return rows.where("value.external IS NOT NULL").select("doc_id")
