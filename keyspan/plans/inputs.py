"""Snapshots, trees and graphs derived from the driver's tables, in Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyspan.schema import content_hash


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def three_snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """base, ours, theirs (key bigint, value string) of orders."""
    orders = table(spark, sf, "orders")
    base = orders.where("o_orderkey % 13 <> 0").selectExpr("o_orderkey AS key", "concat(o_orderstatus, '|', o_orderpriority) AS value")
    new = orders.where("o_orderkey % 13 = 0")
    ours = base.where("key % 11 <> 0").selectExpr("key", "CASE WHEN key % 7 = 0 THEN concat(value, '|o') WHEN key % 10 = 0 THEN concat(value, '|same') ELSE value END AS value").unionByName(
        new.where("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS key", "CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'o' END AS value"))
    theirs = base.where("key % 17 <> 0").selectExpr("key", "CASE WHEN key % 5 = 0 AND key % 10 <> 0 THEN concat(value, '|t') WHEN key % 10 = 0 THEN concat(value, '|same') ELSE value END AS value").unionByName(
        new.where("o_orderkey % 3 <> 1").selectExpr("o_orderkey AS key", "CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 't' END AS value"))
    return base, ours, theirs


SNAPSHOTS_SQL = """
base AS (SELECT o_orderkey AS key, o_orderstatus || '|' || o_orderpriority AS value FROM orders WHERE o_orderkey % 13 <> 0),
ours AS (SELECT key, CASE WHEN key % 7 = 0 THEN value || '|o' WHEN key % 10 = 0 THEN value || '|same' ELSE value END AS value FROM base WHERE key % 11 <> 0
  UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'o' END FROM orders WHERE o_orderkey % 13 = 0 AND o_orderkey % 3 <> 0),
theirs AS (SELECT key, CASE WHEN key % 5 = 0 AND key % 10 <> 0 THEN value || '|t' WHEN key % 10 = 0 THEN value || '|same' ELSE value END AS value FROM base WHERE key % 17 <> 0
  UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 't' END FROM orders WHERE o_orderkey % 13 = 0 AND o_orderkey % 3 <> 1)"""


def document_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Entries lang/source/doc_id of documents."""
    return table(spark, sf, "documents").select(
        F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("key"), F.lit("file").alias("kind"), F.octet_length("text").cast("long").alias("size"),
        F.lit(0o644).alias("mode"), F.col("doc_id").alias("mtime"), F.lit(None).cast("string").alias("target"), content_hash(F.col("text")).alias("content_hash"))


TREE_SQL = "entries AS (SELECT concat_ws('/', lang, source, doc_id::VARCHAR) AS key, 'file' AS kind, octet_length(encode(text))::BIGINT AS size, 420 AS mode, doc_id AS mtime, sha256(text) AS content_hash FROM documents)"


def merge_trees(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Path-keyed snapshots of all customers and nations. Both sides change, move and keep customers; ours adds files where theirs adds directories of that name."""
    nation = table(spark, sf, "nation")
    customers = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    base = customers.selectExpr("concat('c/', c_custkey) AS key", "c_mktsegment AS value").unionByName(nation.selectExpr("concat('r/', n_name) AS key", "concat('o', n_regionkey) AS value"))
    ours = customers.selectExpr("CASE WHEN c_custkey % 7 = 0 THEN concat('moved/', c_custkey) ELSE concat('c/', c_custkey) END AS key", "CASE WHEN c_custkey % 5 = 0 THEN concat(c_mktsegment, '|o') ELSE c_mktsegment END AS value").unionByName(
        nation.selectExpr("explode(array(concat('n/', n_name), concat('r/', n_name))) AS key", "concat('o', n_regionkey) AS value"))
    theirs = customers.selectExpr("CASE WHEN c_custkey % 11 = 0 THEN concat('n/', n_name, '/', c_custkey) ELSE concat('c/', c_custkey) END AS key", "CASE WHEN c_custkey % 3 = 0 THEN concat(c_mktsegment, '|t') ELSE c_mktsegment END AS value").unionByName(
        nation.selectExpr("explode(array(concat('n/', n_name, '-'), concat('r/', n_name))) AS key", "concat(CASE WHEN n_nationkey % 2 = 0 THEN 'p' ELSE 'o' END, n_regionkey) AS value"))
    return base, ours, theirs


MERGE_TREES_SQL = """
cn AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey),
base AS (SELECT 'c/' || c_custkey AS key, c_mktsegment AS value FROM cn UNION ALL SELECT 'r/' || n_name, 'o' || n_regionkey FROM nation),
ours AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN 'moved/' ELSE 'c/' END || c_custkey AS key, c_mktsegment || CASE WHEN c_custkey % 5 = 0 THEN '|o' ELSE '' END AS value FROM cn
  UNION ALL SELECT 'n/' || n_name, 'o' || n_regionkey FROM nation UNION ALL SELECT 'r/' || n_name, 'o' || n_regionkey FROM nation),
theirs AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN 'n/' || n_name || '/' ELSE 'c/' END || c_custkey AS key, c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN '|t' ELSE '' END AS value FROM cn
  UNION ALL SELECT 'n/' || n_name || '-', CASE WHEN n_nationkey % 2 = 0 THEN 'p' ELSE 'o' END || n_regionkey FROM nation
  UNION ALL SELECT 'r/' || n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'p' ELSE 'o' END || n_regionkey FROM nation)"""


def commit_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Commits of all events: the first parent is the user's event before, purchases also merge the event before."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    first = F.lag("event_id").over(w)
    second = F.when((F.col("event_type") == "purchase") & (F.col("event_id") > 0), F.col("event_id") - 1)
    parents = F.transform(F.array_distinct(F.array_compact(F.array(first, second))), lambda x: x.cast("string"))
    return table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("hash"), parents.alias("parents"), F.col("user_id").cast("string").alias("tree"), F.col("user_id").cast("string").alias("author"),
        F.col("event_type").alias("message"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("ts"))


GRAPH_SQL = """
f AS (SELECT event_id, user_id, event_type, ts, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS p1 FROM events),
edges AS (SELECT event_id AS h, p1 AS p FROM f WHERE p1 IS NOT NULL UNION SELECT event_id, event_id - 1 FROM f WHERE event_type = 'purchase' AND event_id > 0)"""
#: Two tips of the graph, as SQL over events and as values: the last purchase and the last event that is none.
TIPS_SQL = """
tips AS (SELECT max(event_id) FILTER (event_type = 'purchase') AS a, max(event_id) FILTER (event_type <> 'purchase') AS b FROM events),
up AS (SELECT 'a' AS side, a AS h FROM tips UNION SELECT 'b', b FROM tips UNION SELECT up.side, edges.p FROM up JOIN edges ON up.h = edges.h)"""


def tips(spark: SparkSession, sf: str) -> tuple[str, str]:
    bought = F.col("event_type") == "purchase"
    r = table(spark, sf, "events").agg(F.max(F.when(bought, F.col("event_id"))).alias("a"), F.max(F.when(~bought, F.col("event_id"))).alias("b")).first()
    return str(r["a"]), str(r["b"])


def objects(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct texts by address."""
    return table(spark, sf, "documents").groupBy(content_hash(F.col("text")).alias("hash")).agg(F.first(F.col("text").cast("binary")).alias("bytes"), F.first(F.octet_length("text")).cast("long").alias("n_bytes"))


def kept_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of documents labelled good."""
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf, "documents").join(good, "doc_id", "left_semi").select(content_hash(F.col("text")).alias("hash")).distinct()


OBJECTS_SQL = """
objects AS (SELECT sha256(text) AS hash, any_value(octet_length(encode(text)))::BIGINT AS n_bytes FROM documents GROUP BY 1),
kept AS (SELECT DISTINCT sha256(text) AS hash FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))"""
