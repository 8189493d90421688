"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function maps the shingles of a whole text to 64-bit values; the k smallest are the document's sketch. Two documents
of similarity t share most of their sketches, so that somewhere two retained values in a row are the same in both: with k = 48
and t = 0.8 a link without such a run has a chance under 1e-14, and sets of at most k shingles always have one. The stages:

1. documents with equal shingle sets form a class; its smallest doc_id stands for it;
2. inverted lists: runs of two retained values point to the classes that hold them;
3. each list's most central class (the one whose lists are longest in all) is compared with those others of the list that share
   three lists with it, and links found there join classes into components;
4. lists that still hold several components yield all pairs between components, if the list is short; pairs with at least three
   runs in common are candidates (a link has fewer with a chance under 1e-9), or with one if the sets are small. A class with a quarter
   of its runs (`hot_share`) in long lists (large groups of near copies, or texts that hold a passage many others share) is paired
   by an exact prefix filter instead: its rarest shingles, a share of 1 - t of the set and one more, meet those of each partner;
5. a candidate pair passes if the union sketch's estimate reaches t less six standard deviations, and is a link if the whole
   shingle sets have the similarity; then components are formed again.

Pairs within a component are never listed, nor are lists or groups gathered in one task.

Defined cases: null or empty text, or text of white space, has the empty set and links with nothing; fewer words than a shingle
count as one shingle; rows with equal doc_id are one document; rows with null doc_id link with nothing and keep a null component;
ties don't arise; other columns are ignored by `near_duplicates`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.llm.common import Scratch, series_udf, trimmed
from keyspan.llm.components import components
from keyspan.llm.words import mix64, word_hashes


@dataclass(frozen=True)
class Params:
    words: int = 5
    percent: int = 80
    k: int = 48
    least_runs: int = 3
    small_set: int = 15
    long_list: int = 64
    hot_share: float = 0.25
    filter_bits: int = 1 << 26
    order_slots: int = 1 << 22


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit values of the shingles."""
    h = word_hashes(text)
    if not len(h):
        return h
    width = min(words, len(h))
    with np.errstate(over="ignore"):
        s = np.full(len(h) - width + 1, np.uint64(0x51ED270B + width), np.uint64)
        for j in range(width):
            s = mix64(s * np.uint64(0x9FB21C651E98DF25) + h[j : len(h) - width + 1 + j])
    return np.unique(s)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def _sketches(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, n, mark, sketch) of every row; mark: 128 bits of the whole set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, p.words) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": [len(s) for s in sets], "mark": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], "sketch": [s[: p.k].tobytes() for s in sets]})

    return docs.mapInPandas(trimmed(run), "doc_id long, n long, mark binary, sketch binary")


def _runs(nodes: DataFrame) -> DataFrame:
    """(run, node): each pair of neighbouring values in a sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in np.array_split(np.arange(len(batch)), max(1, len(batch) // 2000)):
                b = batch.iloc[part]
                values = [np.frombuffer(s, np.uint64) for s in b["sketch"]]
                made = [mix64(v[:-1] * np.uint64(3) + v[1:]) for v in values]
                size = [len(m) for m in made]
                if sum(size):
                    yield pd.DataFrame({"run": _signed(np.concatenate(made)), "node": np.repeat(b["node"].to_numpy(), size)})

    return nodes.where("n >= 2").select("node", "sketch").mapInPandas(trimmed(run), "run long, node long")


def _lists(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(run, node, c) of the runs that several nodes hold, with their number."""
    runs = _runs(nodes)
    several = runs.groupBy("run").agg(F.count("*").alias("c")).where("c > 1")
    return scratch.table(runs.join(several, "run"), "lists")


def _stars(lists: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of a list's most central node, the one whose lists are longest in all, and others that share so many lists with it."""
    weight = lists.groupBy("node").agg(F.sum("c").alias("weight"))
    heads = lists.select("run", "node").join(weight, "node").groupBy("run").agg(F.max(F.struct("weight", (-F.col("node")).alias("n")))["n"].alias("n"))
    pairs = lists.select("run", "node").join(heads.select("run", (-F.col("n")).alias("head")), "run").where("node <> head")
    return pairs.groupBy(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).agg(F.count("*").alias("lists")).where(F.col("lists") >= least).select("a", "b")


def _estimate(p: Params):
    def likely(a: pd.Series, b: pd.Series) -> pd.Series:
        t, out = p.percent / 100, []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            end = min(x[-1] if len(x) == p.k else np.uint64(2**64 - 1), y[-1] if len(y) == p.k else np.uint64(2**64 - 1))
            x, y = x[x <= end], y[y <= end]
            both = len(np.intersect1d(x, y, assume_unique=True))
            union = len(x) + len(y) - both
            out.append(both >= union * t - 6 * np.sqrt(union * t * (1 - t)))
        return pd.Series(out, dtype=bool)

    return series_udf(likely, T.BooleanType())


def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")


def _likely(pairs: DataFrame, nodes: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) of near sizes that the union sketch lets through."""
    a, b = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * p.percent)
    return both.where(_estimate(p)("sa", "sb")).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))


def _verified(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """The links among the pairs (a, b), by whole sets."""
    full = pairs.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b").withColumn("both", series_udf(_shared, T.LongType())("xa", "xb"))
    size = lambda c: F.octet_length(c) / 8
    return full.where(F.col("both") * 100 >= (size("xa") + size("xb") - F.col("both")) * p.percent).select("a", "b")


def _full_sets(docs: DataFrame, wanted: DataFrame, scratch: Scratch, p: Params) -> DataFrame:
    """(node, whole set) of the wanted nodes: a filter of fixed size lets few other documents into the exact join."""
    bits = p.filter_bits

    slot = F.pmod(F.xxhash64("node", F.lit(11)), F.lit(bits))
    seen = wanted.select(slot.alias("slot")).distinct()
    words = seen.groupBy((F.col("slot") / 64).cast("long").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 AS int)))").alias("x"))
    table = np.zeros(bits // 64, np.int64)  # 8 MB at the default size, whatever the input
    got = words.toArrow()
    table[got["w"].to_numpy()] = got["x"].to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = batch["slot"].to_numpy(np.int64)
            b = batch[(held.value[s // 64] >> (s % 64)) & 1 == 1]
            if len(b):
                yield pd.DataFrame({"node": b["doc_id"].to_numpy(), "whole": [shingle_set(t, p.words).tobytes() for t in b["text"]]})

    slots = docs.where("doc_id IS NOT NULL").withColumn("slot", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(bits)))
    return scratch.table(slots.mapInPandas(trimmed(run), "node long, whole binary").join(wanted.select("node").distinct(), "node", "left_semi"), "sets")


def _levels(sets: DataFrame, p: Params) -> np.ndarray:
    """Four times the binary logarithm of how many sets hold a value, by slots of values: the largest of a slot, 0 where each is held once."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                value, c = np.unique(np.concatenate([np.frombuffer(w, np.int64) for w in batch["whole"]]), return_counts=True)
                yield pd.DataFrame({"value": value, "c": c})

    common = sets.mapInPandas(trimmed(count), "value long, c long").groupBy("value").agg(F.sum("c").alias("c")).where("c > 1")
    slots = common.groupBy(F.col("value").bitwiseAND(F.lit(p.order_slots - 1)).alias("slot")).agg(F.max("c").alias("c"))
    words = slots.groupBy((F.col("slot") / 8).cast("long").alias("w")).agg(F.expr("bit_or(shiftleft(floor(4 * log2(c)), cast(8 * (slot % 8) AS int)))").alias("x"))
    table = np.zeros(p.order_slots // 8, "<i8")  # 4 MB at the default size, whatever the input
    got = words.toArrow()
    table[got["w"].to_numpy()] = got["x"].to_numpy()
    return table.view(np.uint8)


def _prefix_lists(sets: DataFrame, hot: DataFrame, scratch: Scratch, p: Params) -> DataFrame:
    """(value, node, n, at, before): the rarest shingles of hot nodes, of which the ends of every link among them share one.

    Any order of the values that is the same for all nodes keeps this exact. They go by level, then by value, so that a set's prefix is made
    where the set lies and no row is made for the values behind it; a rare value that shares a slot with a frequent one only comes later.
    """
    inside = sets.join(hot.select("node"), "node", "left_semi")
    held = sets.sparkSession.sparkContext.broadcast(_levels(inside, p))

    def rarest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for node, whole in zip(batch["node"], batch["whole"], strict=True):
                v = np.frombuffer(whole, np.int64)
                level = held.value[v & (p.order_slots - 1)]
                first = np.lexsort((v, level))[: len(v) * (100 - p.percent) // 100 + 1]
                at = np.flatnonzero(level[first])
                shared = v[first[at]]
                made += [(value, node, len(v), i, shared[: min(j, 16)]) for j, (value, i) in enumerate(zip(shared, at, strict=True))]
            if made:
                yield pd.DataFrame(made, columns=["value", "node", "n", "at", "before"])

    listed = inside.mapInPandas(trimmed(rarest), "value long, node long, n long, at int, before array<long>")
    return scratch.table(listed.distinct(), "hot-lists")


def _prefix_pairs(lists: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) in different components that can still reach the similarity if the value is the first they share.

    Of a link's two sets, what comes before the first shared value isn't shared; so many more values than follow it can't be.
    Where two lists of first values show that an earlier one is shared, that one stands for the pair.
    """
    part = lambda rows, x: rows.select("value", F.col("node").alias(x), F.col("component").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("at").alias(f"i{x}"), F.col("before").alias(f"e{x}"), F.col("main").alias(f"m{x}"))
    # what a list's largest component holds is never paired with itself: one end of a pair lies outside
    a, b = part(lists.where(~F.col("main")), "a"), part(lists, "b")
    most = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    near = a.join(b, "value").where("ca <> cb AND (mb OR a < b)").where(most * (100 + p.percent) >= p.percent * (F.col("na") + F.col("nb"))).where(~F.arrays_overlap("ea", "eb"))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _split_lists(lists: DataFrame, key: str, comp: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of lists that hold several components, with the component and whether it is the list's largest.

    The table of lists is written before it meets the rows, so that both sides of the join come straight from a shuffle and Spark can split a long list.
    """
    named = scratch.table(lists.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    sizes = named.groupBy(key, "component").agg(F.count("*").alias("size"))
    mains = scratch.table(sizes.groupBy(key).agg(F.max(F.struct("size", "component"))["component"].alias("largest"), F.count("*").alias("held")).where("held > 1").select(key, "largest"), "mains")
    return scratch.table(named.join(mains, key).withColumn("main", F.col("component") == F.col("largest")).drop("largest"), "split")


def _pairs_between(lists: DataFrame, key: str, least: int) -> DataFrame:
    """Pairs (a, b) of nodes in different components that share at least so many lists."""
    a, b = (lists.select(key, F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    pairs = a.join(b, key).where("a < b AND ca <> cb")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("lists"), F.first("ca").alias("ca")).where(F.col("lists") >= least).select("a", "b")


def _open_lists(lists: DataFrame, key: str, comp: DataFrame) -> DataFrame:
    """The rows of lists that hold several components, with the component."""
    named = lists.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = named.groupBy(key).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select(key)
    return named.join(several, key)


def _small_pairs(open_: DataFrame, nodes: DataFrame, p: Params) -> DataFrame:
    """Likely pairs of small sets: these may share a single run."""
    small = open_.where(F.col("c") <= p.long_list).join(nodes.where(F.col("n") <= p.small_set).select("node"), "node", "left_semi")
    return _likely(_pairs_between(small, "run", 1), nodes, p)


def _merged(comp: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Components after further links: only the components that these join are looked at again."""
    between = links
    for end in ("a", "b"):
        between = between.join(comp.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left").withColumn(end, F.coalesce(f"c{end}", end)).drop(f"c{end}")
    joined = components(between, scratch)
    above = joined.select(F.col("node").alias("component"), F.col("component").alias("least"))
    moved = comp.join(above, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    return moved.unionByName(joined.join(comp, "node", "left_anti").select("node", "component"))


def near_duplicates(docs: DataFrame, params: Params | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    p, scratch = params or Params(), Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = scratch.table(_sketches(docs, p), "sketches")
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("mark").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("x"))
    nodes = scratch.table(classes.select("mark", F.col("x.doc_id").alias("node"), "x.n", "x.sketch"), "classes")
    lists = _lists(nodes, scratch)
    scratch.settle()
    stars = scratch.table(_likely(_stars(lists, p.least_runs), nodes, p), "stars")
    links = scratch.table(_verified(stars, _full_sets(docs, _ends(stars), scratch, p), p), "links")
    comp = components(links, scratch)
    scratch.drop(stars, links)
    left = scratch.table(_open_lists(lists.select("run", "node", "c"), "run", comp), "open")
    scratch.drop(lists)
    scratch.settle()
    pairs = scratch.table(_likely(_pairs_between(left.where(F.col("c") <= p.long_list), "run", p.least_runs), nodes, p).union(_small_pairs(left, nodes, p)).distinct(), "pairs")
    crowded = left.where(F.col("c") > p.long_list).groupBy("node").agg(F.count("*").alias("hot")).join(nodes.select("node", "n"), "node")
    hot = scratch.table(crowded.where(F.col("hot") >= (F.least(F.col("n"), F.lit(p.k)) - 1) * p.hot_share).select("node"), "hot")
    sets = _full_sets(docs, _ends(pairs).unionByName(hot), scratch, p)
    found = _verified(pairs, sets, p)
    if not hot.isEmpty():
        inside = _split_lists(_prefix_lists(sets, hot, scratch, p), "value", comp, scratch)
        found = found.unionByName(_verified(_likely(_prefix_pairs(inside, p), nodes, p), sets, p))
    found = scratch.table(found, "links")
    if not found.isEmpty():
        comp = _merged(comp, found, scratch)
    named = nodes.select("mark", "node").join(comp, "node", "left").select("mark", F.coalesce("component", "node").alias("component"))
    out = rows.select("doc_id", "n", "mark").join(named, "mark", "left")
    out = out.withColumn("component_id", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """The documents that stay: of each component the smallest doc_id; rows that repeat it stay as well."""
    gone = near_duplicates(docs, params).where(~F.col("kept")).select(F.col("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 2-word shingles at 80 %."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Params(words=2))


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * x >= 80 * (na.n + nb.n - x)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c ON d.doc_id = c.a LEFT JOIN n ON d.doc_id = n.doc_id
"""
