"""Language identification by fusing evidence under Bayes' rule.

log P(language | document) is, up to a constant, the sum of

* ``text_weight`` times the log-likelihood of the text's byte trigrams (hashed to a fixed number of buckets; the weight below 1
  allows for the dependence of neighbouring trigrams),
* log P(declared language | language, one is declared), where declared is the ``lang`` attribute of the text's own ``<html>`` tag, else
  the declared column, with add-a-half counts over the declared codes,
* the log prior of the host, smoothed towards that of its address suffix and that towards the whole corpus; the suffix comes from
  the address column or the first web address in the text, and counts here alone.

Trigram tables come from all documents that declare a language; the other tables are grouped aggregates over all
documents of the text's own best guess. A document is accepted if it holds a letter and its best posterior reaches
``least_posterior``.

Defined cases: null or empty text, or one without letters, gives language null, posterior 0 and is not accepted; a missing
declared language or address is no evidence, a null host is a host of its own; ties go to the language first in alphabetical order; repeated rows
get the same answer each; an empty table gives an empty result. Texts are processed whole, in slices of bounded size. All declared
codes are candidates; their trigram tables are collected, broadcast and multiplied in blocks of ``max_languages``, 64 KB a language.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.llm.common import Scratch, bounded_broadcast, series_udf, trimmed

BUCKETS = 8192
_SLICE = 1 << 20
_TAG = re.compile(r"<[^<>]*>")


@dataclass(frozen=True)
class Params:
    text_weight: float = 0.3
    least_posterior: float = 0.5
    smoothing: float = 20.0
    max_languages: int = 200
    max_broadcast_hosts: int = 100_000


def trigram_counts(text: str) -> np.ndarray:
    """Counts of the hashed byte trigrams of the lower-cased text without its tags."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    out = np.zeros(BUCKETS, np.int64)
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    for at in range(0, max(len(raw) - 2, 0), _SLICE):
        b = raw[at : at + _SLICE + 2].astype(np.uint32)
        h = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
        out += np.bincount(h >> np.uint32(19), minlength=BUCKETS)
    return out


def declared_language(text: Column, declared: Column | None) -> Column:
    """Code of two or three letters from the first html tag with one, wherever in the text, else from the declared column, else the empty string."""
    markup = F.when(F.contains(text, F.lit("<")), F.lower(F.regexp_extract(text, r"(?i)<html[^>]*\blang\s*=\s*[\"']?\s*([a-z]{2,3})(?:$|[^a-z])", 1)))
    given = F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]{2,3})(?:$|[^A-Za-z])", 1)) if declared is not None else F.lit("")
    return F.coalesce(F.when(markup != "", markup), given, F.lit(""))


def address_suffix(text: Column, address: Column | None) -> Column:
    """The last label of the host in the address, else in the first web address of the text, else the empty string."""
    host = F.regexp_extract(F.coalesce(address, F.lit("")), r"^(?:[a-z]+://)?([^/?#\s:]+)", 1) if address is not None else F.lit("")
    mentioned = F.when(F.contains(text, F.lit("://")), F.regexp_extract(text, r"https?://([A-Za-z0-9.-]+)", 1)).otherwise("")
    found = F.when(host != "", host).otherwise(mentioned)
    return F.coalesce(F.lower(F.regexp_extract(found, r"\.([A-Za-z]{2,24})\.?$", 1)), F.lit(""))


def _evidence(docs: DataFrame, text: str, declared: str | None, address: str | None, host: str | None) -> DataFrame:
    """docs in one struct column `row`, beside the pieces of evidence."""
    t = F.col(text)
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(t, F.lit("")).alias("text"),
        declared_language(t, F.col(declared) if declared else None).alias("declared"), address_suffix(t, F.col(address) if address else None).alias("suffix"),
        (F.coalesce(F.col(host).cast("string"), F.lit("")) if host else F.lit("")).alias("host"))


def fit_text(evidence: DataFrame, p: Params, scratch: Scratch) -> tuple[list[str], list[Broadcast]]:
    """Candidate languages in alphabetical order, and log-probabilities [bucket, language] of trigrams for each block of max_languages of them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, np.int64))
        for batch in batches:
            for text, lang in zip(batch["text"], batch["declared"], strict=True):
                sums[lang] += trigram_counts(text)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})

    named = evidence.where("declared <> ''").select("text", "declared")
    cells = named.mapInPandas(trimmed(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    cells = scratch.table(cells, "trigrams")
    langs = [r["lang"] for r in cells.select("lang").distinct().orderBy("lang").collect()]
    blocks = []
    for first in range(0, len(langs), p.max_languages):
        block = langs[first : first + p.max_languages]
        found = cells.where(F.col("lang").between(block[0], block[-1])).toArrow().to_pandas()  # at most BUCKETS rows a language
        counts = np.full((BUCKETS, len(block)), 0.5)
        counts[found["bucket"], np.searchsorted(block, found["lang"].to_numpy(str))] += found["n"]
        blocks.append(evidence.sparkSession.sparkContext.broadcast(np.log(counts / counts.sum(0))))
    scratch.drop(cells)
    return langs, blocks


def _text_scores(text: str, blocks: list[Broadcast]) -> np.ndarray | None:
    """Log-likelihood of the text for each language; None if it has no letter."""
    if not any(map(str.isalpha, text)):
        return None
    n = trigram_counts(text)
    return np.concatenate([n @ b.value for b in blocks])


def _guesser(blocks: list[Broadcast]):
    def guess(texts: pd.Series) -> pd.Series:
        scores = (_text_scores(t, blocks) for t in texts)
        return pd.Series([-1 if s is None else int(s.argmax()) for s in scores], dtype="int32")

    return series_udf(guess, T.IntegerType())


def fused(s: np.ndarray, whole: np.ndarray, n_suffix: np.ndarray, n_host: np.ndarray, n_said: np.ndarray | None, declaring: np.ndarray, p: Params) -> np.ndarray:
    """Log-posterior of each language but for a constant: the text's log-likelihoods s, and by guess the documents in all, of the suffix, of the host, that declare the same, and that declare anything."""
    top = whole / whole.sum()
    prior = (n_suffix + p.smoothing * top) / (n_suffix.sum() + p.smoothing)
    z = s * p.text_weight + np.log((n_host + p.smoothing * prior) / (n_host.sum() + p.smoothing))
    return z if n_said is None else z + np.log((n_said + 0.5) / (declaring + 0.5 * len(whole)))


def _fuser(blocks: list[Broadcast], whole: np.ndarray, declaring: np.ndarray, p: Params):
    """The place of the best language (-1 if the text has no letter) and its posterior, from the text and the counts (sparse, by guess) of its suffix, host and declared language."""

    def dense(places: np.ndarray | None, counts: np.ndarray | None) -> np.ndarray:
        out = np.zeros(len(whole))
        if places is not None:
            out[places] = counts
        return out

    def fuse(texts: pd.Series, declared: pd.Series, sg: pd.Series, sn: pd.Series, hg: pd.Series, hn: pd.Series, dg: pd.Series, dn: pd.Series) -> pd.DataFrame:
        best, posterior = [], []
        for t, said, *cells in zip(texts, declared, sg, sn, hg, hn, dg, dn, strict=True):
            s = _text_scores(t, blocks)
            if s is None:
                best.append(-1)
                posterior.append(0.0)
                continue
            n_suffix, n_host, n_said = (dense(*cells[i : i + 2]) for i in (0, 2, 4))
            z = fused(s, whole, n_suffix, n_host, n_said if said else None, declaring, p)
            best.append(int(z.argmax()))
            posterior.append(1 / np.exp(z - z.max()).sum())
        return pd.DataFrame({"g": np.array(best, np.int32), "posterior": posterior})

    return series_udf(fuse, "g int, posterior double")


def _tally(cells: DataFrame, keys: list[str], name: str) -> DataFrame:
    """For each key the guesses and their counts, as two arrays."""
    sums = cells.groupBy(*keys, "g").agg(F.sum("count").alias("n"))
    pairs = sums.groupBy(*keys).agg(F.collect_list(F.struct("g", "n")).alias("x"))
    return pairs.select(*keys, F.col("x.g").alias(f"{name}g"), F.col("x.n").alias(f"{name}n"))


def identify(docs: DataFrame, text: str = "text", declared: str | None = "lang", address: str | None = None, host: str | None = "source", params: Params | None = None) -> DataFrame:
    """Columns row (the input row), declared, language, posterior, accepted."""
    p, spark = params or Params(), docs.sparkSession
    evidence = _evidence(docs, text, declared, address, host)
    scratch = Scratch(spark)
    langs, blocks = fit_text(evidence, p, scratch)
    if not langs:
        return evidence.select("row", "declared", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted"))
    guesses = evidence.select("suffix", "host", "declared", _guesser(blocks)("text").alias("g")).where("g >= 0")
    cells = scratch.table(guesses.groupBy("suffix", "host", "declared", "g").count(), "cells")
    whole, declaring = np.ones(len(langs)), np.zeros(len(langs))
    for r in cells.groupBy("g").agg(F.sum("count").alias("n"), F.sum(F.when(F.col("declared") != "", F.col("count")).otherwise(0)).alias("said")).collect():  # at most a row per language
        whole[r["g"]] += r["n"]
        declaring[r["g"]] = r["said"]
    prior = scratch.table(_tally(cells, ["suffix", "host"], "h").join(_tally(cells, ["suffix"], "s"), "suffix"), "prior")
    said = scratch.table(_tally(cells, ["declared"], "d"), "declared")
    joined = evidence.join(bounded_broadcast(prior, p.max_broadcast_hosts), ["suffix", "host"], "left").join(bounded_broadcast(said, p.max_broadcast_hosts), "declared", "left")
    names = F.array(*map(F.lit, langs))
    fused = joined.withColumn("found", _fuser(blocks, whole, declaring, p)("text", "declared", "sg", "sn", "hg", "hn", "dg", "dn"))
    return fused.select("row", "declared", F.when(F.col("found.g") >= 0, F.element_at(names, F.col("found.g") + 1)).alias("language"), F.col("found.posterior").alias("posterior")).withColumn("accepted", F.col("language").isNotNull() & (F.col("posterior") >= p.least_posterior))


def accept(docs: DataFrame) -> DataFrame:
    """The accepted documents, with the language found in `lang`."""
    found = identify(docs).where("accepted")
    return found.select(*[F.col("language").alias("lang") if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, posterior and acceptance of every document."""
    found = identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "declared", "language", "posterior", "accepted")

