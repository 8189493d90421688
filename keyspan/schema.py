"""Column layouts shared by the operators, and the one place that knows how content is addressed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Content of up to this many bytes stays in its row; larger content lives in the object table.
INLINE_LIMIT = 64
FILE, DIRECTORY, SYMLINK = "file", "directory", "symlink"

SNAPSHOT = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType(), False)])
ENTRY = T.StructType([
    T.StructField("key", T.StringType(), False), T.StructField("kind", T.StringType(), False), T.StructField("size", T.LongType()),
    T.StructField("mode", T.IntegerType()), T.StructField("mtime", T.LongType()), T.StructField("target", T.StringType()), T.StructField("content_hash", T.StringType())])
OBJECT = T.StructType([T.StructField("hash", T.StringType(), False), T.StructField("kind", T.StringType(), False), T.StructField("bytes", T.BinaryType(), False)])
COMMIT = T.StructType([
    T.StructField("hash", T.StringType(), False), T.StructField("parents", T.ArrayType(T.StringType(), False), False), T.StructField("tree", T.StringType()),
    T.StructField("author", T.StringType()), T.StructField("message", T.StringType()), T.StructField("ts", T.LongType(), False)])
REF = T.StructType([T.StructField("container", T.StringType(), False), T.StructField("kind", T.StringType(), False), T.StructField("name", T.StringType(), False), T.StructField("commit", T.StringType())])
PEER = T.StructType([T.StructField("name", T.StringType(), False), T.StructField("address", T.StringType(), False), T.StructField("pubkey", T.StringType(), False), T.StructField("role", T.StringType(), False)])


def content_hash(content: Column) -> Column:
    """Address of a byte string or text: 64 lower-case hex digits."""
    return F.sha2(content.cast("binary"), 256)


def stored_value(content: Column) -> Column:
    """struct(inline, external): small content itself, else its address."""
    small = F.octet_length(content) <= INLINE_LIMIT
    return F.struct(F.when(small, content.cast("binary")).alias("inline"), F.when(~small, content_hash(content)).alias("external"))
