"""Near-duplicate vectors: tiles along principal axes, compared leading dimensions first.

Equal vectors of one label form a class with one representative. Unit vectors are turned to the axes of largest scatter within
labels and sorted by label and by cells of the first two axes into tiles of at most ``tile`` vectors. Two unit vectors of cosine
t lie at most sqrt(2 - 2t) apart on every axis, so only tiles whose boxes come that close are compared. Within a pair of tiles
the inner products of the leading axes are accumulated first; with the norms of what remains they bound the cosine, and pairs
that can't reach t drop out depth by depth. Those left are confirmed in double precision on the vectors as given. A pair of
tiles yields per vector the number of its links and one link towards its local component, never the pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with null label or vec_id, link
with nothing (n_links 0, component their own id, kept); vectors of different length don't link; equal vectors link with each
other; rows that repeat a vec_id with another vector are one vector with the links of all; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.llm.common import Scratch
from keyspan.llm.components import components

LEADING = 8


@dataclass(frozen=True)
class Params:
    cosine: float = 0.98
    tile: int = 1024


def usable(vector: Column) -> Column:
    """Not null nor empty, and all components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def units(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _axes(nodes: DataFrame) -> dict[int, np.ndarray]:
    """For each length, an orthonormal basis by falling scatter of differences between neighbours of one label."""

    def scatter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in batch.groupby("d"):
                part = part.sort_values("label")
                u, label = units(np.stack(part["v"].to_numpy())), part["label"].to_numpy()
                gap = (u[1:] - u[:-1])[label[1:] == label[:-1]]
                i, j = np.meshgrid(np.arange(d), np.arange(d), indexing="ij")
                yield pd.DataFrame({"d": d, "i": i.ravel(), "j": j.ravel(), "s": (gap.T @ gap).ravel()})

    sums = nodes.select("label", "v", F.size("v").alias("d")).mapInPandas(scatter, "d int, i int, j int, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s"))
    out: dict[int, np.ndarray] = {}
    for r in sums.collect():  # the square of the length for each length
        out.setdefault(r["d"], np.zeros((r["d"], r["d"])))[r["i"], r["j"]] = r["s"]
    return {d: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy() for d, m in out.items()}


def _tiles(nodes: DataFrame, axes: dict[int, np.ndarray], p: Params) -> DataFrame:
    """(tile, label, d, lo, hi, nodes, weights, raw) along the axes."""
    held, reach = nodes.sparkSession.sparkContext.broadcast(axes), np.sqrt(2 - 2 * p.cosine)

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in batch.groupby("d"):
                m = np.stack(part["v"].to_numpy()).astype(np.float64)
                y = units(m) @ held.value[d][:, :LEADING]
                cell = np.floor(y[:, :2] / reach).astype(np.int64)
                yield pd.DataFrame({"node": part["node"], "label": part["label"], "d": d, "weight": part["weight"], "q1": cell[:, 0], "q2": cell[:, -1], "y": y[:, min(2, d - 1)], "raw": [x.tobytes() for x in m], "head": [x.tobytes() for x in y]})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, held_back = TaskContext.get().partitionId() << 32, None

        def row(part: pd.DataFrame) -> pd.DataFrame:
            nonlocal number
            number += 1
            y = np.stack([np.frombuffer(x) for x in part["head"]])
            return pd.DataFrame({"tile": [number], "label": [part["label"].iloc[0]], "d": [part["d"].iloc[0]], "lo": [y.min(0)], "hi": [y.max(0)], "nodes": [part["node"].to_numpy()], "weights": [part["weight"].to_numpy()], "raw": [b"".join(part["raw"])]})

        for batch in batches:
            rows = batch if held_back is None else pd.concat([held_back, batch], ignore_index=True)
            held_back = None
            groups = list(rows.groupby(["label", "d"], sort=False))
            for at, (_, group) in enumerate(groups):
                whole = len(group) // p.tile * p.tile if at == len(groups) - 1 else len(group)
                for a in range(0, whole, p.tile):
                    yield row(group.iloc[a : min(a + p.tile, whole)])
                if whole < len(group):
                    held_back = group.iloc[whole:]
        if held_back is not None:
            yield row(held_back)

    turned = nodes.select("node", "label", "weight", "v", F.size("v").alias("d")).mapInPandas(turn, "node long, label string, d int, weight long, q1 long, q2 long, y double, raw binary, head binary")
    order = ["label", "d", "q1", "q2", "y", "node"]
    return turned.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(cut, "tile long, label string, d int, lo array<double>, hi array<double>, nodes array<long>, weights array<long>, raw binary")


def _tile_pairs(tiles: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b), a <= b, of tiles whose boxes come within reach."""
    reach = float(np.sqrt(2 - 2 * p.cosine)) + 1e-9
    boxes = tiles.select("tile", "label", "d", "lo", "hi")
    side = lambda box, axis: F.coalesce(F.get(box, F.lit(axis)), F.lit(0.0))  # noqa: E731 - vectors of one component have one axis
    bins = lambda axis: F.sequence(F.floor((side("lo", axis) - reach / 2) / reach), F.floor((side("hi", axis) + reach / 2) / reach))
    # boxes within reach overlap on each axis once both are widened by half of it, so they share a bin of the first two axes together
    binned = boxes.withColumn("bin", F.explode(bins(0))).withColumn("bin2", F.explode(bins(1)))
    a, b = (binned.select("label", "d", "bin", "bin2", F.col("tile").alias(n), F.col("lo").alias(f"lo_{n}"), F.col("hi").alias(f"hi_{n}")) for n in "ab")
    gaps = F.zip_with(F.zip_with("lo_a", "hi_b", lambda x, y: x - y), F.zip_with("lo_b", "hi_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)
    return a.join(b, ["label", "d", "bin", "bin2"]).where("a <= b").where(apart <= reach * reach).select("a", "b").distinct()


def linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray, t: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the rows of a and b (of one tile: i < j) whose cosine is at least t."""
    ya, yb, d = units(a) @ axes, units(b) @ axes, a.shape[1]
    depths = [k for k in (LEADING, 16, 32) if k < d] + [d]
    rest = lambda y: [np.sqrt(np.maximum((y[:, k:] ** 2).sum(1), 0)) for k in depths]
    ra, rb, out = rest(ya), rest(yb), []
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    for at in range(0, len(a), 256):
        rows = slice(at, at + 256)
        s = ya[rows, : depths[0]] @ yb[:, : depths[0]].T
        i, j = np.nonzero(s + np.outer(ra[0][rows], rb[0]) >= t - 1e-9)
        if same:
            i, j = i[i + at < j], j[i + at < j]
        for c in range(0, len(i), 100_000):
            x, y = i[c : c + 100_000] + at, j[c : c + 100_000]
            s_ = s[x - at, y]
            for k0, k1, fa, fb in zip(depths, depths[1:], ra[1:], rb[1:], strict=False):
                s_ = s_ + np.einsum("ij,ij->i", ya[x, k0:k1], yb[y, k0:k1])
                on = s_ + fa[x] * fb[y] >= t - 1e-9
                x, y, s_ = x[on], y[on], s_[on]
            cosine = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y])
            if not np.isfinite(cosine).all():  # squares beyond the range of doubles
                cosine = np.einsum("ij,ij->i", units(a[x]), units(b[y])) if len(x) else cosine
            out.append((x[cosine >= t], y[cosine >= t]))
    return (np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])) if out else (np.zeros(0, int), np.zeros(0, int))


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of n indexes reaches over the links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(pairs: DataFrame, tiles: DataFrame, axes: dict[int, np.ndarray], p: Params) -> DataFrame:
    """(node, n, root) for the linked nodes of each pair of tiles."""
    held = tiles.sparkSession.sparkContext.broadcast(axes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                a, b = (np.frombuffer(x).reshape(-1, r.d) for x in (r.raw_a, r.raw_b))
                i, j = linked(a, b, held.value[r.d], p.cosine, r.a == r.b)
                if not len(i):
                    continue
                if r.a == r.b:
                    nodes, weights = r.nodes_a, np.asarray(r.weights_a)
                else:
                    nodes, weights, j = np.concatenate([r.nodes_a, r.nodes_b]), np.concatenate([r.weights_a, r.weights_b]), j + len(a)
                n = np.bincount(i, weights[j], len(nodes)) + np.bincount(j, weights[i], len(nodes))
                on = np.flatnonzero(n)
                yield pd.DataFrame({"node": nodes[on], "n": n[on].astype(np.int64), "root": nodes[local_roots(len(nodes), i, j)[on]]})

    body = lambda n: tiles.select(F.col("tile").alias(n), *(["d"] if n == "a" else []), F.col("nodes").alias(f"nodes_{n}"), F.col("weights").alias(f"weights_{n}"), F.col("raw").alias(f"raw_{n}"))
    return pairs.join(body("a"), "a").join(body("b"), "b").mapInPandas(run, "node long, n long, root long")


def near_vectors(vectors: DataFrame, params: Params | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    p, scratch = params or Params(), Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    ready = usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.exists("v", lambda x: x != 0)
    marked = rows.withColumn("ready", F.coalesce(ready, F.lit(False))).withColumn("mark", F.when(F.col("ready"), F.struct(F.xxhash64("label", "v").alias("x"), F.xxhash64(F.lit(3), "v", "label").alias("y"))))
    classes = marked.where("ready").groupBy("mark").agg(F.min(F.struct("vec_id", "label", "v")).alias("c"), F.count("*").alias("weight"))
    nodes = scratch.table(classes.select("mark", F.col("c.vec_id").alias("node"), "c.label", "c.v", "weight"), "classes")
    axes = _axes(nodes)
    tiles = scratch.table(_tiles(nodes, axes, p), "tiles")
    pairs = scratch.table(_tile_pairs(tiles, p), "pairs")
    found = scratch.table(_compare(pairs.repartition("a", "b"), tiles, axes, p), "links")
    comp = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    named = nodes.select("mark", "node", "weight").join(links, "node", "left").join(comp, "node", "left")
    named = named.select("mark", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "node").alias("c"))
    out = marked.select("vec_id", "mark").join(named, "mark", "left").select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.98 within a label."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON e.vec_id = c.a LEFT JOIN n ON e.vec_id = n.a
"""
