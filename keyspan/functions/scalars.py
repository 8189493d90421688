"""Scalar functions on metadata as column expressions: sizes, times, names, image references, policies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Registry used for references that name none, and the prefix of its official images.
DEFAULT_REGISTRY = "registry-1.docker.io"
OFFICIAL = "library/"
#: Roles by rising power; restart policies; network modes.
ROLES = ("read", "sync", "deploy")
RESTART = ("no", "on-failure", "always")
NETWORKS = ("none", "host")


def format_ts(seconds: Column) -> Column:
    """Epoch seconds as 'YYYY-MM-DD HH:MM:SS UTC' (session time zone UTC)."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss 'UTC'")


def parse_size(text: Column) -> Column:
    """Bytes of '512', '512K', '64M', '2G' or '10B'; null for anything else or beyond a long."""
    t = F.trim(text)
    pattern = r"^\+?([0-9]+)\s*([KkMmGgBb]?)$"
    number = F.regexp_extract(t, pattern, 1).try_cast("bigint")
    unit = F.upper(F.regexp_extract(t, pattern, 2))
    factor = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(1).cast("bigint")
    return F.when(t.rlike(pattern), F.try_multiply(number, factor))


def is_hash(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{64}$")


def hash_bytes(text: Column) -> Column:
    """32 bytes of 64 hex digits in either case, else null."""
    return F.when(is_hash(text), F.unhex(text))


def is_hex_prefix(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]+$")


def valid_name(name: Column) -> Column:
    """Whether a branch or container may have the name."""
    return (name != "") & ~name.rlike(r"[/\x00]|\.\.|^[.-]")


def image_ref(text: Column) -> Column:
    """struct(registry, repo, reference); null for a blank text."""
    t = F.trim(text)
    part = lambda i: F.regexp_extract(t, r"(?s)^(?:(localhost|[^/]*[.:][^/]*)/)?(.*?)(?:@(.*)|:([^:@]*))?$", i)
    registry, name, digest, tag = (part(i) for i in (1, 2, 3, 4))
    repo = F.when((registry != "") | F.contains(name, F.lit("/")), name).otherwise(F.concat(F.lit(OFFICIAL), name))
    reference = F.coalesce(F.nullif(digest, F.lit("")), F.nullif(tag, F.lit("")), F.when(~t.rlike("[:@]$"), "latest"), F.lit(""))
    return F.when(t != "", F.struct(F.coalesce(F.nullif(registry, F.lit("")), F.lit(DEFAULT_REGISTRY)).alias("registry"), repo.alias("repo"), reference.alias("reference")))


def image_name(text: Column) -> Column:
    """Last path segment of the image without tag or digest."""
    return F.substring_index(image_ref(text)["repo"], "/", -1)


def volume_spec(text: Column) -> Column:
    """struct(host, container, readonly) of 'host:container[:ro|rw]', null if malformed."""
    parts = F.split(text, ":", 3)
    mode = F.get(parts, F.lit(2))
    ok = (F.size(parts) >= 2) & (F.get(parts, F.lit(0)) != "") & F.get(parts, F.lit(1)).startswith("/") & (mode.isNull() | mode.isin("ro", "rw"))
    return F.when(ok, F.struct(F.get(parts, F.lit(0)).alias("host"), F.get(parts, F.lit(1)).alias("container"), F.coalesce(mode == "ro", F.lit(False)).alias("readonly")))


def known(text: Column, values: tuple[str, ...]) -> Column:
    """The text if it is one of the values, else null."""
    return F.when(text.isin(*values), text)


def wants_restart(policy: Column, exit_code: Column) -> Column:
    return (policy == "always") | ((policy == "on-failure") & (exit_code != 0))


def is_supervised(policy: Column) -> Column:
    return policy != "no"


def role_rank(role: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ROLES)), role)


def role_allows(role: Column, needed: Column) -> Column:
    """Whether the role is known and at least as powerful as the one needed."""
    return (role_rank(role) > 0) & (role_rank(needed) > 0) & (role_rank(role) >= role_rank(needed))


def author(flag: Column, environment: Column) -> Column:
    return F.coalesce(F.nullif(flag, F.lit("")), F.nullif(environment, F.lit("")), F.lit("user"))


def argv(shell: Column, words: Column) -> Column:
    """Command as words: a text runs in a shell, an array as it is."""
    return F.coalesce(words, F.when(shell.isNotNull(), F.array(F.lit("/bin/sh"), F.lit("-c"), shell)))


def truncate(text: Column, n: int) -> Column:
    """At most n bytes stay whole; longer texts keep the whole characters of their first n - 1 bytes, then an ellipsis."""
    sizes = F.transform(F.split(F.substring(text, 1, n), ""), lambda c: F.octet_length(c))  # no more characters can stay
    keep = F.aggregate(sizes, F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("chars")), lambda a, s: F.when((s > 0) & (a["bytes"] >= 0) & (a["bytes"] + s <= n - 1), F.struct((a["bytes"] + s).alias("bytes"), (a["chars"] + 1).alias("chars"))).otherwise(F.struct(F.lit(-1 << 30).alias("bytes"), a["chars"].alias("chars"))))
    return F.when(F.octet_length(text) <= n, text).otherwise(F.concat(F.substring(text, F.lit(1), keep["chars"]), F.lit("…")))


def verify_digest(content: Column, digest: Column) -> Column:
    """Whether 'sha256:<hex>' is the content's digest; other algorithms fail."""
    return F.lower(digest).startswith("sha256:") & (F.sha2(content.cast("binary"), 256) == F.lower(F.substring(digest, 8, 1 << 30)))


def compression(content: Column) -> Column:
    """gzip, zstd or raw by the first bytes."""
    hexed = F.hex(F.substring(content.cast("binary"), 1, 4))
    return F.when(hexed.startswith("1F8B"), "gzip").when(hexed == "28B52FFD", "zstd").otherwise("raw")


def read_range(content: Column, offset: Column, size: Column) -> Column:
    """Bytes from offset on, clamped to the end."""
    return F.substring(content.cast("binary"), (offset + 1).cast("int"), size.cast("int"))


def splice(content: Column, offset: Column, written: Column) -> Column:
    """Content with bytes written at the offset; a gap before it is filled with zeros."""
    c, w = F.hex(content.cast("binary")), F.hex(written.cast("binary"))
    padded = F.rpad(c, F.greatest(F.length(c), offset * 2), "0")
    return F.unhex(F.concat(F.substring(padded, F.lit(1), offset * 2), w, F.substring(padded, offset * 2 + F.length(w) + 1, F.length(padded))))


def resize(content: Column, size: Column) -> Column:
    """Content cut or filled with zeros to the size."""
    return F.unhex(F.substring(F.rpad(F.hex(content.cast("binary")), F.greatest(size * 2, F.lit(0)), "0"), F.lit(1), size * 2))


def control_verb(line: Column) -> Column:
    """struct(verb, argument) of a control line: the first word, and the rest without white space around it."""
    t = F.trim(line)
    return F.struct(F.regexp_extract(t, r"^(\S*)", 1).alias("verb"), F.trim(F.regexp_extract(t, r"(?s)^\S*\s*(.*)$", 1)).alias("argument"))
