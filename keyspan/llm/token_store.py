"""Content-addressed store of token ids.

A document is encoded whole, its end id is appended, and a rolling hash over windows of ids cuts the stream into chunks. A
store is a folder with three Parquet tables:

* ``chunks``   (digest, width, payload): every distinct chunk once, its ids little-endian in 2 or 4 bytes, zstd-compressed;
* ``recipes``  (part, pos, doc_id, n_tokens, digests, lengths, leaf): a row per document in ascending doc_id order, over
  files that follow that order; ``leaf`` hashes the document's id and digests;
* ``manifest`` (part, n_rows, n_tokens, start, root): the Merkle root of each part's leaves and the ids before the part.

Null text counts as empty (the end id alone). Rows that repeat a doc_id are kept, each with a recipe of its own. Null doc_ids
sort first. Other columns of the input are ignored, whatever their names. An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.llm.common import Scratch, trimmed
from keyspan.llm.encoding import CachedEncoder

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 2**64)
_WINDOW = 16
ENCODED = "doc_id long, n_tokens long, digests array<binary>, lengths array<int>, widths array<int>, payloads array<binary>"


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done, step = 1, base % 2**64
    while done < n:  # doubles what is there: out[done + i] = out[i] * base**done
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        done, step = done + more, step * step % 2**64
    return out


@lru_cache(4)
def _power_table(n: int, base: int) -> np.ndarray:
    return _powers(n, base)


def _first_powers(n: int, base: int) -> np.ndarray:
    return _power_table(1 << max(12, (n - 1).bit_length()), base)[:n]


def cut_all(ids: np.ndarray, ends: np.ndarray, mean: int = 512, least: int = 64, most: int = 4096) -> list[list[int]]:
    """For each of the documents that stand one after the other in ids, the ends of its chunks, counted from its first id: where
    the hash of the document's last 16 ids says so, between least and most ids after the last cut."""
    begins = np.append(0, ends[:-1])
    n = len(ids)
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed * _first_powers(n, _MULTIPLIER), dtype=np.uint64, out=sums[1:])
        first = np.repeat(begins, ends - begins)  # a window doesn't reach into the document before
        hashed = (sums[1:] - sums[np.maximum(np.arange(1 - _WINDOW, n + 1 - _WINDOW), first)]) * _first_powers(n, _INVERSE) * np.uint64(0x94D049BB133111EB)
    marks = np.flatnonzero((hashed >> np.uint64(32)) % np.uint64(mean) == 0) + 1
    bounds = np.searchsorted(marks, begins, "right").tolist()
    marks = marks.tolist()
    out = []
    for k, (begin, end) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
        cuts, last = [], begin
        for i in range(bounds[k], bounds[k + 1] if k + 1 < len(bounds) else len(marks)):
            m = marks[i]
            while m - last > most:
                last += most
                cuts.append(last - begin)
            if m - last >= least:
                cuts.append(m - begin)
                last = m
        while end - last > most:
            last += most
            cuts.append(last - begin)
        if last < end:
            cuts.append(end - begin)
        out.append(cuts)
    return out


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document."""
    return cut_all(ids, np.array([len(ids)]))[0] if len(ids) else []


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def encode_documents(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its chunks; ENCODED. A chunk that a task has met before has a null payload."""

    def stored(doc_ids: list, documents: list[np.ndarray], pack, seen: set[bytes]) -> pa.RecordBatch:
        ids = np.concatenate(documents).astype("<u4", copy=False)
        ends = np.cumsum([len(d) for d in documents])
        digests, lengths, widths, payloads, first = [], [], [], [], [0]
        for begin, cuts in zip(np.append(0, ends[:-1]).tolist(), cut_all(ids, ends), strict=True):
            last = begin
            for cut in cuts:
                part = ids[last : begin + cut]
                last = begin + cut
                width = 2 if part.max() < 65536 else 4
                digest = _digest(part)
                digests.append(digest)
                lengths.append(len(part))
                widths.append(width)
                payloads.append(None if digest in seen else pack.compress(part.astype("<u2") if width == 2 else part))
                seen.add(digest)
            first.append(len(digests))
        offsets = pa.array(first, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((digests, pa.binary()), (lengths, pa.int32()), (widths, pa.int32()), (payloads, pa.binary()))]
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([len(d) for d in documents], pa.int64()), *lists], ["doc_id", "n_tokens", "digests", "lengths", "widths", "payloads"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, seen = zstandard.ZstdCompressor(level=3), set()  # digests of this task's chunks, whose bytes go on once
        enc = CachedEncoder(path, "attached")
        for batch in batches:
            doc_ids, documents, size = [], [], 0
            for doc_id, ids in zip(batch["i"].to_pylist(), enc.encode_all(batch["t"]), strict=True):
                doc_ids.append(doc_id)
                documents.append(np.append(ids, np.uint32(end_id)))
                size += len(ids) + 1
                if size > 1 << 20:
                    yield stored(doc_ids, documents, pack, seen)
                    doc_ids, documents, size = [], [], 0
            if documents:
                yield stored(doc_ids, documents, pack, seen)

    source = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return source.mapInArrow(trimmed(run), ENCODED)


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is; no leaves: the digest of nothing."""
    if not leaves:
        return _digest(b"")
    while len(leaves) > 1:
        pairs = [_digest(a + b) for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves = pairs + leaves[len(pairs) * 2 :]
    return leaves[0]


def _leaf(doc_id, digests: list[bytes]) -> bytes:
    return _digest(repr(None if pd.isna(doc_id) else int(doc_id)).encode() + b"\0" + b"".join(digests))


@F.pandas_udf(T.BinaryType())
def _leaves(ids: pd.Series, digests: pd.Series) -> pd.Series:
    return pd.Series([_leaf(i, list(d)) for i, d in zip(ids, digests, strict=True)])


def _roots(recipes: DataFrame) -> DataFrame:
    def root(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        return pd.DataFrame([(group["part"].iloc[0], len(group), group["n_tokens"].sum(), merkle_root(list(group["leaf"])))], columns=["part", "n_rows", "n_tokens", "root"])

    return recipes.select("part", "pos", "n_tokens", "leaf").groupBy("part").applyInPandas(root, "part int, n_rows long, n_tokens long, root binary")


def write_store(docs: DataFrame, where: str, path: str, end_id: int) -> None:
    """Writes the three tables under where."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    staged = scratch.table(encode_documents(docs, path, end_id), "encoded")
    chunk = F.explode(F.arrays_zip("digests", "widths", "payloads")).alias("c")
    chunks = staged.select(chunk).select("c.digests", "c.widths", "c.payloads").where("payloads IS NOT NULL")
    chunks.groupBy(F.col("digests").alias("digest")).agg(F.first("widths").alias("width"), F.first("payloads").alias("payload")).write.parquet(f"{where}/chunks")
    ordered = staged.select("doc_id", "n_tokens", "digests", "lengths").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("digests")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("digests"))
    numbered = ordered.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    numbered.select("part", "pos", "doc_id", "n_tokens", "digests", "lengths", _leaves("doc_id", "digests").alias("leaf")).write.parquet(f"{where}/recipes")
    scratch.drop(staged)
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    roots = _roots(spark.read.parquet(f"{where}/recipes"))  # a row per written part: as many as there are partitions
    roots.withColumn("start", before).coalesce(1).write.parquet(f"{where}/manifest")


@lru_cache(1)
def _shift_tables(bits: int = 48) -> np.ndarray:
    """[bit, byte, value]: the CRC-32 register after 2**bit zero bytes, for each byte of the register before."""
    table = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)
    out = np.zeros((bits, 4, 256), np.uint32)
    for byte in range(4):
        x = np.arange(256, dtype=np.uint32) << np.uint32(8 * byte)
        out[0, byte] = table[x & np.uint32(255)] ^ (x >> np.uint32(8))
    for k in range(1, bits):
        for byte in range(4):
            x = out[k - 1, byte]
            out[k, byte] = _apply(out[k - 1], x)
    return out


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & np.uint32(255)] ^ tables[1][(x >> np.uint32(8)) & np.uint32(255)] ^ tables[2][(x >> np.uint32(16)) & np.uint32(255)] ^ tables[3][x >> np.uint32(24)]


def shift_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What crc contributes to the CRC-32 of a string when n_bytes follow: the CRC of a whole is the xor over its pieces."""
    tables, x, n = _shift_tables(), crc.astype(np.uint32), n_bytes.astype(np.int64)
    for k in range(int(n.max(initial=0)).bit_length()):
        on = (n >> k) & 1 == 1
        x[on] = _apply(tables[k], x[on])
    return x


def _ids(width: int, payload: bytes, unpack) -> np.ndarray:
    return np.frombuffer(unpack.decompress(payload), "<u2" if width == 2 else "<u4").astype("<u4")


def read_chunks(spark: SparkSession, where: str) -> DataFrame:
    """(digest, intact, n, crc) of every stored chunk, from its bytes; intact: they hash to the digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            raw = [_ids(w, p, unpack).tobytes() for w, p in zip(batch["width"], batch["payload"], strict=True)]
            yield pd.DataFrame({"digest": batch["digest"], "intact": [_digest(r) == bytes(d) for r, d in zip(raw, batch["digest"], strict=True)], "n": [len(r) // 4 for r in raw], "crc": [zlib.crc32(r) for r in raw]})

    return spark.read.parquet(f"{where}/chunks").mapInPandas(trimmed(run), "digest binary, intact boolean, n long, crc long")


@F.pandas_udf(T.LongType())
def _shifted(crc: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series(shift_crc(crc.to_numpy(), after.to_numpy() * 4).astype(np.int64))


def _steps(spark: SparkSession, where: str) -> DataFrame:
    recipes = spark.read.parquet(f"{where}/recipes")
    after = F.expr("aggregate(slice(lengths, seq + 2, greatest(size(lengths) - seq - 1, 0)), 0L, (a, x) -> a + x)")
    return recipes.select("part", "pos", "doc_id", "n_tokens", "lengths", F.posexplode("digests").alias("seq", "digest")).withColumn("after", after).drop("lengths")


def read_digests(spark: SparkSession, where: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, intact) of every document, from the store's files in ascending doc_id order.

    Lengths and checksums come from the chunks' bytes; a document is intact if all its chunks are there and hash to their
    digests, and its part's recipes hash to the root in the manifest.
    """
    steps = _steps(spark, where)
    joined = steps.join(read_chunks(spark, where), "digest", "left")
    docs = joined.withColumn("x", _shifted(F.coalesce("crc", F.lit(0)), "after")).groupBy("part", "pos").agg(
        F.first("doc_id").alias("doc_id"), F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.first("n_tokens").alias("n_tokens"), F.bit_xor("x").alias("ids_crc32"), F.min(F.coalesce("intact", F.lit(False))).alias("whole"))
    recipes = spark.read.parquet(f"{where}/recipes").withColumn("leaf", _leaves("doc_id", "digests"))
    manifest = spark.read.parquet(f"{where}/manifest")
    again = _roots(recipes).select("part", F.col("root").alias("found"))
    parts = manifest.join(again, "part", "left").select("part", "start", F.col("root").eqNullSafe(F.col("found")).alias("sealed"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    return docs.withColumn("inside", inside).join(parts, "part").select(
        "doc_id", (F.col("start") + F.col("inside")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32", (F.col("whole") & F.col("sealed") & (F.col("n") == F.col("n_tokens"))).alias("intact"))


def read_documents(spark: SparkSession, where: str) -> DataFrame:
    """(doc_id, ids) rebuilt from the store."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            ids = [np.concatenate([_ids(c["width"], c["payload"], unpack) for c in chunks]).astype(np.int64) for chunks in batch["chunks"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids})

    steps = _steps(spark, where).join(spark.read.parquet(f"{where}/chunks"), "digest")
    docs = steps.groupBy("part", "pos").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("seq", "width", "payload"))).alias("chunks"))
    return docs.select("doc_id", "chunks").mapInPandas(trimmed(run), "doc_id long, ids array<long>")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in byte-level ids with end id 2, written to a store and read back."""
    import public_tokenizers

    where = Scratch(spark).path("store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), where, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_digests(spark, where)
