"""Exact top-k search by inner product with a three-phase uniform threshold.

A score is the sum of m partial scores, one for each slice of the dimensions, so a query has m score lists. Vectors are dealt to
blocks by a hash. Phase 1: a query gathers its score lists in its own block alone, takes the best entries of each and their
whole scores; the k-th best of these bounds the final k-th score from below. Phase 2: that cutoff goes to all blocks; an entry can
only reach it if one of its partial scores reaches the m-th part. A block keeps its entries of every slice in falling order of
their norm, reads each list only as deep as norms allow that part, and collects the entries that reach it. Phase 3: partial
scores that are still missing are resolved for the collected entries, slice by slice, as long as what is known and the bound on the
rest reach the cutoff; each query's best are merged over blocks, a bounded number from each.

Query blocks travel to vector blocks, each of which is read once. Components are floor(scale * x) as integers and scores are exact
integers: in doubles where no sum can pass 2**53, in Python integers (cut to the range of long) beyond. Ties go to the smaller vec_id.

Defined cases: vectors that are null or hold null or non-finite components, and rows with null vec_id, take no part; only
vectors of equal length meet; of rows that repeat a vec_id the one with the smallest vector counts; a query without any
candidate has no row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyspan.llm.common import Scratch, trimmed
from keyspan.llm.embeddings import usable

_LONG = 2**63


@dataclass(frozen=True)
class Params:
    k: int = 5
    scale: int = 256
    every: int = 50
    slices: int = 4
    block: int = 8192
    query_block: int = 128


BLOCK = "b int, d int, part int, ids binary, vals binary, type string, cutoffs binary"


def _packed(b: int, d: int, part: int, ids: np.ndarray, whole: np.ndarray, cutoffs: np.ndarray | None = None) -> pd.DataFrame:
    kind = "<i2" if np.abs(whole).max(initial=0) < 2**15 else "<f8"
    return pd.DataFrame({"b": [b], "d": [d], "part": [part], "ids": [ids.astype("<i8").tobytes()], "vals": [whole.astype(kind).tobytes()], "type": [kind], "cutoffs": [None if cutoffs is None else cutoffs.astype("<f8").tobytes()]})


def _unpacked(r) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(r.ids, "<i8")
    return ids, np.frombuffer(r.vals, r.type).reshape(len(ids), r.d).astype(np.float64)


def _blocks(vectors: DataFrame, p: Params) -> tuple[DataFrame, int]:
    """Blocks of about `block` vectors, their ids ascending (part -1), and their number."""
    n = max(1, -(-vectors.count() // p.block))

    def pack(batch: pd.DataFrame) -> pd.DataFrame:
        whole = np.floor(np.stack(batch["v"].to_numpy()).astype(np.float64) * p.scale)
        order = np.lexsort((*whole.T[::-1], batch["id"].to_numpy()))
        ids, whole = batch["id"].to_numpy()[order], whole[order]
        first = np.append(True, ids[1:] != ids[:-1])
        return _packed(int(batch["b"].iloc[0]), whole.shape[1], -1, ids[first], whole[first])

    # of rows that repeat an id all but the least vector go before rows gather, so that a block stays a block
    single = vectors.groupBy("id", F.size("v").alias("d")).agg(F.min("v").alias("v"))
    dealt = single.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    return dealt.groupBy("b", "d").applyInPandas(pack, BLOCK), n


def _cuts(d: int, slices: int) -> list[tuple[int, int]]:
    at = np.linspace(0, d, min(slices, max(d, 1)) + 1).astype(int).tolist()
    return list(zip(at, at[1:], strict=False))


def _exact(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matrices as they are if no score can pass what doubles hold exactly, else as Python integers."""
    if np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(q.shape[1], 1) < 2**53:
        return q, v
    return tuple(np.array([[int(x) for x in r] for r in m], object).reshape(m.shape) for m in (q, v))


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of each row."""
    if s.shape[1] <= k:
        return np.broadcast_to(np.arange(s.shape[1]), s.shape)
    return np.argsort(-s, 1, kind="stable")[:, :k] if s.dtype == object else np.argpartition(s, -k, 1)[:, -k:]


def cutoffs_in(q: np.ndarray, v: np.ndarray, own: np.ndarray, p: Params) -> np.ndarray:
    """Phase 1 in one block: for each query the k-th best whole score of the entries that lead one of its lists; own: the query's row, left out."""
    q, v = _exact(q, v)
    lists = [q[:, a:b] @ v[:, a:b].T for a, b in _cuts(q.shape[1], p.slices)]
    whole = sum(lists[1:], lists[0]) if lists else np.zeros((len(q), len(v)))
    out = np.full(len(q), -np.inf)
    for i in range(len(q)):
        lead = np.setdiff1d(np.concatenate([_best(s[i : i + 1], p.k + 1)[0] for s in lists]) if lists else np.arange(len(v)), own[i : i + 1])
        if len(lead) >= p.k:
            x = np.sort(whole[i][lead])[-p.k]
            out[i] = np.nextafter(float(x), -np.inf) if abs(x) >= 2**53 else float(x)
    return out


class Lists:
    """A block's entries, for every slice in falling order of their norm."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, p: Params):
        self.ids, self.values, self.p = ids, values, p
        self.cuts = _cuts(values.shape[1], p.slices)
        self.norm = [np.sqrt((values[:, a:b] ** 2).sum(1)) * (1 + 1e-12) for a, b in self.cuts]
        self.order = [np.argsort(-n, kind="stable") for n in self.norm]
        self.sorted = [values[o, a:b] for o, (a, b) in zip(self.order, self.cuts, strict=True)]
        self.touched = 0  # partial scores computed

    def reaching(self, q: np.ndarray, cutoffs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Phases 2 and 3: (query's row, columns whose score reaches its cutoff, their scores)."""
        m, whole = max(len(self.cuts), 1), float(np.abs(q).max(initial=0)) * float(np.abs(self.values).max(initial=0)) * max(q.shape[1], 1) < 2**53
        q_norm = [np.sqrt((q[:, a:b] ** 2).sum(1)) * (1 + 1e-12) for a, b in self.cuts]
        least = cutoffs / m
        seen: list[list[np.ndarray]] = [[] for _ in q]
        dense: dict[int, np.ndarray] = {}
        for s, (a, b) in enumerate(self.cuts):
            # a list is read as deep as an entry's norm allows it the uniform part of the cutoff; one that may be zero or less is read whole
            need = np.where(least > 0, least / np.maximum(q_norm[s], 1e-300), 0.0)
            depth = int(np.searchsorted(-self.norm[s][self.order[s]], -need.min(initial=np.inf), "right")) if len(need) else 0
            if whole:
                part = q[:, a:b] @ self.sorted[s][:depth].T
                self.touched += part.size
                for i in range(len(q)):
                    seen[i].append(self.order[s][np.flatnonzero(part[i] >= least[i])])
            else:
                for i in range(len(q)):
                    seen[i].append(self.order[s])
        collected = [np.unique(np.concatenate(x)) if self.cuts else np.arange(len(self.ids)) for x in seen]
        most = sum(4 * len(c) > len(self.ids) for c in collected) * 2 > len(q)
        for i, cols in enumerate(collected):
            if not whole:
                score = np.array([sum(int(x) * int(y) for x, y in zip(q[i], self.values[c], strict=True)) for c in cols], object)
                on = score >= cutoffs[i] if len(cols) else np.zeros(0, bool)
                yield i, cols[on.astype(bool)], score[on.astype(bool)]
                continue
            score = np.zeros(len(cols))
            bound = sum((q_norm[s][i] * self.norm[s][cols] for s in range(len(self.cuts))), np.zeros(len(cols)))
            for s, (a, b) in enumerate(self.cuts):
                if most and 4 * len(cols) > len(self.ids):  # where most queries ask for much of the block, one product for all is cheaper than picking rows
                    if s not in dense:
                        dense[s] = q[:, a:b] @ self.values[:, a:b].T
                        self.touched += dense[s].size
                    score = score + dense[s][i, cols]
                else:
                    score = score + self.values[cols, a:b] @ q[i, a:b]
                    self.touched += len(cols)
                bound = bound - q_norm[s][i] * self.norm[s][cols]
                on = score + bound * (1 + 1e-9) + 1e-6 >= cutoffs[i]
                cols, score, bound = cols[on], score[on], bound[on]
            on = score >= cutoffs[i]
            yield i, cols[on], score[on]


def _own(ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """The place of each query among a block's ids, or -1."""
    at = np.searchsorted(ids, queries)
    return np.where((at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == queries), at, -1)


def _long(x) -> int:
    return max(-_LONG, min(_LONG - 1, int(x)))


def top_k(vectors: DataFrame, params: Params | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each row whose id is a multiple of `every`."""
    p, scratch = params or Params(), Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull())
    found_blocks, n = _blocks(rows, p)
    blocks = scratch.table(found_blocks, "blocks")

    def phase1(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                ids, v = _unpacked(r)
                asked = np.flatnonzero(ids % p.every == 0)
                for part, a in enumerate(range(0, len(asked), p.query_block)):
                    at = asked[a : a + p.query_block]
                    yield _packed(r.b, r.d, part, ids[at], v[at], cutoffs_in(v[at], v, at, p))

    def phase23(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists, place = None, None
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if r.part < 0:
                    lists, place = Lists(*_unpacked(r), p), (r.b, r.d)
                    continue
                if place != (r.b, r.d):
                    continue  # no vector of this length in the block
                qid, q = _unpacked(r)
                own = _own(lists.ids, qid)
                for i, cols, score in lists.reaching(q, np.frombuffer(r.cutoffs, "<f8")):
                    on = cols != own[i]
                    cols, score = cols[on], score[on]
                    best = np.argsort(-score, kind="stable")[: p.k]
                    out += [(int(qid[i]), int(lists.ids[c]), _long(x)) for c, x in zip(cols[best], score[best], strict=True)]
            if out:
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    queries = scratch.table(blocks.mapInPandas(trimmed(phase1), BLOCK), "queries")
    # a vector block comes first in its partition, then the query blocks that visit it
    visits = queries.withColumn("part", F.hash("b", "part").bitwiseAND(F.lit((1 << 30) - 1))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    stream = blocks.unionByName(visits).repartition(min(n, 100_000), "b").sortWithinPartitions("b", "d", "part")
    found = stream.mapInPandas(trimmed(phase23), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every fiftieth."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
