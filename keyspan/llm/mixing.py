"""Mixing sources to target weights by iterative proportional fitting.

Tokens (white-space words) are counted over all documents for each cell of source, language and topic. Raking multiplies the
cells' weights until their margins match the targets for sources, languages and topics. A document is kept with a probability
proportional to its cell's calibrated weight; the largest such probability is 1, so no margin is bent by clipping. The draw is
a hash of the document's id, text and a seed, so it can be repeated and doesn't depend on partitioning.

The topic is a column if one is named, else the coarse subject that the form of the text gives (`topic_of`).

Targets are shares per value. Where none are given, the share of tokens to a power below 1 is taken, which lifts rare values. Values
without a target get none of the weight and are left out only if targets were given.

Defined cases: null source, language or text form the values '' of their margin (null or empty text has no tokens and its cell,
if it holds no tokens at all, keeps weight 1); repeated rows share one draw; an empty table gives an empty result; other columns
pass through whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.llm.common import Scratch, bounded_broadcast

MARGINS = ("source", "language", "topic")


@dataclass(frozen=True)
class Params:
    power: dict[str, float] = field(default_factory=lambda: {"source": 0.8, "language": 0.9, "topic": 1.0})  # the forms of texts keep their shares while sources and languages move
    targets: dict[str, dict[str, float]] = field(default_factory=dict)
    rounds: int = 50
    tolerance: float = 1e-9
    max_driver_cells: int = 500_000
    seed: int = 7


def token_count(text: Column) -> Column:
    """Words of the whole text."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def topic_of(text: Column) -> Column:
    """A coarse subject from the form of the text: contact, record, list or prose."""
    return (
        F.when(F.contains(text, F.lit("@")), "contact").when(F.contains(text, F.lit(" | ")), "list")
        .when(text.rlike(r"[0-9]{6}"), "record").otherwise("prose"))


def _cells(docs: DataFrame, source: Column, language: Column, text: Column, topic: Column | None = None) -> DataFrame:
    safe = F.coalesce(text, F.lit(""))
    subject = topic_of(safe) if topic is None else F.coalesce(topic.cast("string"), F.lit(""))
    return docs.withColumn("cell", F.struct(F.coalesce(source.cast("string"), F.lit("")).alias("source"), F.coalesce(language.cast("string"), F.lit("")).alias("language"), subject.alias("topic"))).withColumn("tokens", token_count(safe).cast("long"))


def _target(tokens: dict[str, float], p: Params, margin: str) -> dict[str, float]:
    if margin in p.targets:
        raw = {v: p.targets[margin].get(v, 0.0) if n > 0 else 0.0 for v, n in tokens.items()}
    else:
        raw = {v: n ** p.power[margin] if n > 0 else 0.0 for v, n in tokens.items()}
    total = sum(raw.values())
    return {v: x / total for v, x in raw.items()} if total else raw


def rake(cells: list[tuple[tuple[str, str, str], float]], p: Params) -> list[float]:
    """Weight of a token in each cell, from the cells' tokens: margins of the weighted tokens match the targets."""
    n = np.array([c[1] for c in cells], float)
    share = n / n.sum() if n.sum() else n
    w = np.ones(len(cells))
    codes, targets = [], []
    for axis, margin in enumerate(MARGINS):
        values = sorted({c[0][axis] for c in cells})
        place = {v: i for i, v in enumerate(values)}
        code = np.array([place[c[0][axis]] for c in cells], np.int64)
        goal = _target(dict(zip(values, np.bincount(code, n, len(values)), strict=True)), p, margin)
        codes.append(code)
        targets.append(np.array([goal[v] for v in values]))
    for _ in range(p.rounds):
        off = 0.0
        for code, goal in zip(codes, targets, strict=True):
            now = np.bincount(code, share * w, len(goal))
            factor = np.where(now > 0, goal / np.where(now > 0, now, 1), 1.0)
            off = max(off, np.abs(factor - 1).max(initial=0))
            w *= factor[code]
        if off < p.tolerance:
            break
    return w.tolist()


def _rake_frame(cells: DataFrame, p: Params, scratch: Scratch) -> DataFrame:
    """The same on a table of cells too large for the driver."""
    now = cells.withColumn("w", F.lit(1.0))
    for margin in MARGINS:
        tokens = cells.groupBy(margin).agg(F.sum("tokens").alias("t"))
        if margin in p.targets:
            given = cells.sparkSession.createDataFrame(list(p.targets[margin].items()), f"{margin} string, raw double")
            raw = tokens.join(given, margin, "left").withColumn("raw", F.when(F.col("t") > 0, F.coalesce("raw", F.lit(0.0))).otherwise(0.0))
        else:
            raw = tokens.withColumn("raw", F.when(F.col("t") > 0, F.pow("t", F.lit(p.power[margin]))).otherwise(0.0))
        total = raw.agg(F.sum("raw")).first()[0] or 1.0
        now = now.join(raw.select(margin, (F.col("raw") / total).alias(f"goal_{margin}")), margin)
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    for _ in range(p.rounds):
        before = now
        for margin in MARGINS:
            sums = now.groupBy(margin).agg(F.sum(F.col("tokens") / total * F.col("w")).alias("have"))
            factor = F.when(F.col("have") > 0, F.col(f"goal_{margin}") / F.col("have")).otherwise(1.0)
            now = now.join(sums, margin).withColumn("w", F.col("w") * factor).drop("have")
        now = scratch.table(now, "raked")
        off = now.join(before.select(*MARGINS, F.col("w").alias("was")), list(MARGINS)).agg(F.max(F.abs(F.col("w") - F.col("was")))).first()[0] or 0.0
        if off < p.tolerance:
            break
    return now.select(*MARGINS, "tokens", "w")


def probabilities(docs: DataFrame, source: str = "source", language: str = "lang", text: str = "text", params: Params | None = None, topic: str | None = None) -> DataFrame:
    """(source, language, topic, tokens, probability) of every cell."""
    p, spark = params or Params(), docs.sparkSession
    scratch = Scratch(spark)
    bare = docs.select(F.col(source).alias("s"), F.col(language).alias("l"), F.col(text).alias("t"), (F.col(topic) if topic else F.lit(None)).alias("subject"))
    cells = scratch.table(_cells(bare, F.col("s"), F.col("l"), F.col("t"), F.col("subject") if topic else None).groupBy("cell").agg(F.sum("tokens").alias("tokens")).select("cell.*", "tokens"), "cells")
    schema = "source string, language string, topic string, tokens long, w double"
    if cells.limit(p.max_driver_cells + 1).count() <= p.max_driver_cells:
        rows = [((r["source"], r["language"], r["topic"]), r["tokens"]) for r in cells.orderBy(*MARGINS).collect()]
        weighed = spark.createDataFrame([(*c, n, w) for (c, n), w in zip(rows, rake(rows, p), strict=True)], schema)
    else:
        weighed = _rake_frame(cells, p, scratch)
    top = weighed.where("tokens > 0").agg(F.max("w")).first()[0] or 1.0
    return weighed.select(*MARGINS, "tokens", F.when(F.col("tokens") > 0, F.col("w") / top).otherwise(1.0).alias("probability"))


def drawn(docs: DataFrame, source: str = "source", language: str = "lang", text: str = "text", key: str = "doc_id", params: Params | None = None, topic: str | None = None) -> DataFrame:
    """Columns row (the input row), source, language, topic, tokens, probability, kept."""
    p = params or Params()
    odds = bounded_broadcast(probabilities(docs, source, language, text, p, topic).drop("tokens"), p.max_driver_cells)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    cells = _cells(held, F.col(f"row.`{source}`"), F.col(f"row.`{language}`"), F.col(f"row.`{text}`"), F.col(f"row.`{topic}`") if topic else None).select("row", "cell.*", "tokens")
    draw = F.pmod(F.xxhash64(F.col(f"row.`{key}`"), F.col(f"row.`{text}`"), F.lit(p.seed)), F.lit(1 << 52)) / float(1 << 52)
    return cells.join(odds, list(MARGINS)).withColumn("kept", draw < F.col("probability"))


def mix(docs: DataFrame) -> DataFrame:
    """The documents drawn."""
    return drawn(docs).where("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell, probability and draw of every document."""
    found = drawn(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("row.doc_id").alias("doc_id"), *MARGINS, "tokens", "probability", "kept")
