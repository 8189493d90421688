"""Best-two-fit packing of encoded documents into sequences of a fixed capacity.

Piece lengths are whole numbers up to the capacity, so the packer works on the histogram of lengths: a table of at most
``capacity`` counts however many documents there are. It fills a bin greedily, largest piece first, then replaces the bin's
smallest piece with two unpacked pieces that fit the expanded gap more tightly, and repeats that bin as often as the counts
allow. Pieces of one length are interchangeable; their rank among equals (from per-partition counts, never one global sort)
picks the bin and place.

Null text counts as empty. An empty document still has its end id, so it has one piece. Documents longer than the capacity
are cut into pieces of the capacity, the last may be shorter; shorter documents are never cut. Repeated rows are packed once
each. Other columns of the input are ignored, whatever their names. An empty table packs into no sequence.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.llm.common import Scratch, series_udf, trim, trimmed
from keyspan.llm.encoding import CachedEncoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, k long"
PLACED = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def cut_documents(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; k numbers the pieces of one length within the partition pid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seen = TaskContext.get().partitionId(), Counter()
        enc = CachedEncoder(path, "words", 12 << 20)
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            doc, number, start, length, crc, rank = rows
            for doc_id, ids in zip(batch["i"].to_pylist(), enc.encode_all(batch["t"]), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4", copy=False)
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    n = len(part)
                    doc.append(doc_id)
                    number.append(piece)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    rank.append(seen[n])
                    seen[n] += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(x, t) for x, t in zip(rows, types, strict=True)]
            arrays.insert(5, pa.array([pid] * len(doc), pa.int32()))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "pid", "k"])
            trim()  # what a batch of texts took

    source = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return source.mapInArrow(trimmed(run), PIECES)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of the pieces in a bin, number of such bins), from the number of pieces of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    sizes = sorted(left)
    out: list[tuple[list[int], int]] = []
    while sizes:
        used: Counter[int] = Counter()
        spare = lambda n: left[n] - used[n]
        bin_, gap = [], capacity
        while True:  # the largest piece that fits, again and again
            at = bisect_right(sizes, gap) - 1
            while at >= 0 and spare(sizes[at]) <= 0:
                at -= 1
            if at < 0:
                break
            bin_.append(sizes[at])
            used[sizes[at]] += 1
            gap -= sizes[at]
        smallest = bin_[-1]
        if gap:
            pair = tightest_pair([n for n in sizes if n <= gap + smallest], spare, gap + smallest)
            if pair and sum(pair) > smallest:
                bin_[-1:] = pair
                used[smallest] -= 1
                used.update(pair)
        times = min(left[n] // c for n, c in used.items() if c)
        out.append((bin_, times))
        for n, c in used.items():
            left[n] -= c * times
        sizes = [n for n in sizes if left[n]]
    return out


def tightest_pair(sizes: list[int], spare, room: int) -> list[int] | None:
    """Two free lengths with the largest sum within room."""
    free = np.array([n for n in sizes if spare(n) > 0], np.int64)
    if not len(free):
        return None
    other = np.searchsorted(free, room - free, "right") - 1
    sums = np.where(other >= 0, free + free[other], -1)
    for i in np.argsort(-sums, kind="stable"):
        if sums[i] <= 0:
            return None
        a, b = int(free[i]), int(free[other[i]])
        if a != b or spare(a) >= 2:
            return sorted((a, b), reverse=True)
    return None


def placements(bins: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: the first rank, the pieces a bin, the first bin and the first slot of each run of equal bins, and the slots' offsets."""
    runs: dict[int, list[list]] = {}
    next_rank: Counter[int] = Counter()
    base = 0
    for pieces, times in bins:
        offsets: dict[int, list[int]] = {}
        at = 0
        for n in pieces:
            offsets.setdefault(n, []).append(at)
            at += n
        for n, slots in offsets.items():
            runs.setdefault(n, [[], [], [], [], []])
            first, per, bin_, slot, flat = runs[n]
            first.append(next_rank[n])
            per.append(len(slots))
            bin_.append(base)
            slot.append(len(flat))
            flat.extend(slots)
            next_rank[n] += len(slots) * times
        base += times
    return {n: tuple(np.array(x, np.int64) for x in r) for n, r in runs.items()}


def pack(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.table(cut_documents(docs, path, end_id, capacity), "pieces")
    per_part = scratch.table(pieces.groupBy("pid", "length").count(), "counts")
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    where = docs.sparkSession.sparkContext.broadcast(placements(best_two_fit(counts, capacity)))

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        seq, off, ranks, lengths = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), rank.to_numpy(), length.to_numpy()
        for n in np.unique(lengths):
            on = np.flatnonzero(lengths == n)
            first, per, bin_, slot, flat = where.value[int(n)]
            run = np.searchsorted(first, ranks[on], "right") - 1
            local = ranks[on] - first[run]
            seq[on] = bin_[run] + local // per[run]
            off[on] = flat[slot[run] + local % per[run]]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = per_part.select("pid", "length", (F.sum("count").over(before) - F.col("count")).alias("first"))
    placed = pieces.join(starts, ["pid", "length"]).withColumn("at", series_udf(place, PLACED)("length", F.col("first") + F.col("k")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def pack_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Production parameters: lower-cased word BPE, end id 0, 2048 tokens a sequence."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 0, 2048)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
