"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. The number of documents with each combination of
votes (at most 3 to the power of the labellers, however many documents) is all that expectation-maximisation needs to estimate
each labeller's behaviour given the hidden class. The posterior of the class given the votes then labels a sample of at most
``sample_docs`` documents, those with the smallest hashes of id and text (the same ones whatever the partitioning), on which a
linear scorer over hashed features is trained in one task.
The scorer rates all documents; those below ``least_score`` are rejected.

Defined cases: null or empty text has no words, gets score 0 and is rejected; null ids are scored like any other; repeated rows
get the same score; ties don't arise, every row is judged by itself; other columns pass through whatever their names; an empty
table gives an empty result. Texts are processed whole.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.llm.common import bounded_batches, series_udf, trimmed

DIMENSIONS = 8192
_STYLE = 512  # the last dimensions hold bucketed style measures
_SLICE = 1 << 20
_SYMBOLS = np.array([chr(i) in "!#$%&*|<>{}[]\\^~=+_@/" for i in range(256)])
_UPPER = np.array([65 <= i <= 90 for i in range(256)])
_LOWER = np.array([97 <= i <= 122 for i in range(256)])
GOOD, BAD, NONE = 1, 0, 2


@dataclass(frozen=True)
class Params:
    sample_docs: int = 4000
    rounds: int = 30
    em_rounds: int = 100
    rate: float = 0.5
    decay: float = 1e-4
    least_score: float = 0.5
    seed: int = 17


def style(text: str) -> np.ndarray:
    """Repeated neighbours, upper case, symbols, plain words, distinct words, sentence ends and repeated lines, as shares; last the word count."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(8)
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    upper, lower = raw[_UPPER].sum(), raw[_LOWER].sum()
    plain = sum(w.rstrip(".,;:?!'\")").lstrip("'\"(").isalpha() for w in words)
    lines = [x for x in text.split("\n") if x.strip()]
    return np.array([
        sum(map(operator.eq, words, words[1:])) / n, upper / max(upper + lower, 1), raw[_SYMBOLS].sum() / max(raw.sum(), 1), plain / n,
        len(set(words)) / n, (raw[ord(".")] + raw[ord("?")]) / n, 1 - len(set(lines)) / max(len(lines), 1), n])


def votes(s: np.ndarray) -> list[int]:
    """One vote of each labeller."""
    repeats, upper, symbols, plain, distinct, stops, lines, n = s

    def between(x: float, good: float, bad: float) -> int:
        """Towards good lies the better side."""
        if good < bad:
            return GOOD if x <= good else BAD if x >= bad else NONE
        return GOOD if x >= good else BAD if x <= bad else NONE

    long = n >= 20
    return [
        between(repeats, 0.04, 0.15), between(upper, 0.15, 0.3) if n >= 3 else NONE, between(symbols, 0.005, 0.02), between(plain, 0.9, 0.7) if n >= 3 else NONE,
        between(distinct, 0.3, 0.1) if long else NONE, between(stops, 0.02, 0.004) if long else NONE, between(lines, 0.1, 0.4) if long else NONE]


LABELLERS = 7


def vote_code(text: str) -> int:
    s = style(text)
    return sum(v * 3**i for i, v in enumerate(votes(s) if s[-1] else [BAD] * LABELLERS))


def posterior_by_code(counts: dict[int, int], rounds: int) -> np.ndarray:
    """P(good | votes) for every code, from the number of documents with each, by expectation-maximisation."""
    codes = np.arange(3**LABELLERS)
    digits = codes[:, None] // 3 ** np.arange(LABELLERS) % 3
    n = np.array([counts.get(int(c), 0) for c in codes], float)
    q = np.clip(0.5 + ((digits == GOOD).sum(1) - 2 * (digits == BAD).sum(1)) / (2 * LABELLERS), 0.02, 0.98)
    onehot = np.stack([digits == v for v in (BAD, GOOD)], 2).astype(float)  # a labeller that says nothing tells nothing
    for _ in range(rounds):
        table = np.stack([np.einsum("c,cjv->jv", n * w, onehot) + 1.0 for w in (1 - q, q)])
        table /= table.sum(2, keepdims=True)
        share = np.clip((n @ q + 1) / (n.sum() + 2), 0.01, 0.99)
        log = np.stack([np.einsum("cjv,jv->c", onehot, np.log(t)) for t in table])
        gap = np.clip(log[1] - log[0] + np.log(share / (1 - share)), -60, 60)
        q = 1 / (1 + np.exp(-gap))
    return q


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values: log counts of hashed byte trigrams at unit length, and bucketed style measures."""
    counts = np.zeros(DIMENSIONS, np.int64)
    raw = np.frombuffer(f" {text} ".encode(), np.uint8)
    for at in range(0, max(len(raw) - 2, 0), _SLICE):
        b = raw[at : at + _SLICE + 2].astype(np.uint32)
        h = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
        counts += np.bincount((h >> np.uint32(8)) % np.uint32(DIMENSIONS - _STYLE), minlength=DIMENSIONS)
    at = np.flatnonzero(counts)
    value = np.log1p(counts[at])
    value /= max(np.sqrt((value**2).sum()), 1e-9)
    s = style(text)
    levels = np.minimum((np.sqrt(np.clip(s[:-1], 0, 1)) * 24).astype(int), 24)
    own = DIMENSIONS - _STYLE + np.arange(len(levels)) * 25 + levels
    return np.concatenate([at, own]), np.concatenate([value, np.full(len(own), 0.3)])


def train(idx: list[np.ndarray], val: list[np.ndarray], target: np.ndarray, p: Params) -> np.ndarray:
    """Weights and, last, the bias of a logistic scorer; each document weighs as its label is sure."""
    w, g = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-8)
    sure = np.abs(2 * target - 1)
    for label in (target >= 0.5, target < 0.5):  # the classes weigh alike
        sure[label] /= max(sure[label].sum(), 1e-9)
    sure *= len(target) / 2
    rng = np.random.default_rng(p.seed)
    for _ in range(p.rounds):
        for part in np.array_split(rng.permutation(len(target)), max(1, len(target) // 64)):
            d = p.decay * w
            for i in part:
                z = w[idx[i]] @ val[i] + w[-1]
                e = sure[i] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target[i]) / len(part)
                d[idx[i]] += e * val[i]
                d[-1] += e
            g += d * d
            w -= p.rate * d / np.sqrt(g)
    return w


def _code_column(docs: DataFrame, text: str) -> DataFrame:
    def code(texts: pd.Series) -> pd.Series:
        return texts.map(vote_code).astype("int32")

    return docs.select(series_udf(code, T.IntegerType())(F.coalesce(F.col(text), F.lit(""))).alias("code"))


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", params: Params | None = None) -> np.ndarray | None:
    """The scorer's weights; None for a table without rows."""
    p = params or Params()
    bounded_batches(docs.sparkSession)
    counts = {r["code"]: r["count"] for r in _code_column(docs, text).groupBy("code").count().collect()}  # at most 3**LABELLERS rows
    total = sum(counts.values())
    if not total:
        return None
    q = posterior_by_code(counts, p.em_rounds)
    keyed = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(F.col(key), F.col(text), F.lit(p.seed)).alias("h"))
    last = keyed.select("h").orderBy("h").limit(p.sample_docs).agg(F.max("h")).first()[0]
    picked = keyed.where(F.col("h") <= last).dropDuplicates(["h"])

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [features(t) for t in batch["text"]]
            yield pd.DataFrame({"h": batch["h"], "idx": [a for a, _ in made], "val": [b for _, b in made], "target": [float(q[vote_code(t)]) for t in batch["text"]]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ = pd.concat([pd.DataFrame({"h": [], "idx": [], "val": [], "target": []}), *batches]).sort_values("h")
        if len(all_):
            yield pd.DataFrame({"w": [train(list(map(np.asarray, all_["idx"])), list(map(np.asarray, all_["val"])), all_["target"].to_numpy(float), p)]})

    sample = picked.mapInPandas(trimmed(prepare), "h long, idx array<int>, val array<double>, target double")
    found = sample.repartition(1).mapInPandas(learn, "w array<double>").first()
    return np.array(found["w"]) if found else np.zeros(DIMENSIONS + 1)


def scored(docs: DataFrame, weights: np.ndarray | None, text: str = "text", params: Params | None = None) -> DataFrame:
    """Columns row (the input row), quality, accepted."""
    p = params or Params()
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(weights if weights is not None else np.zeros(DIMENSIONS + 1))

    def score(texts: pd.Series) -> pd.Series:
        def one(t: str) -> float:
            if not t.split():
                return 0.0
            i, v = features(t)
            return float(1 / (1 + np.exp(-np.clip(held.value[i] @ v + held.value[-1], -40, 40))))

        return texts.map(one).astype(float)

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), series_udf(score, T.DoubleType())(F.coalesce(F.col(text), F.lit(""))).alias("quality"))
    return rows.withColumn("accepted", F.col("quality") >= p.least_score)


def accept(docs: DataFrame) -> DataFrame:
    """The accepted documents."""
    return scored(docs, fit(docs)).where("accepted").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score and acceptance of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, fit(docs)).select(F.col("row.doc_id").alias("doc_id"), "quality", "accepted")
