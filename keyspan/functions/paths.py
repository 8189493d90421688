"""Path functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))


def normalize_path(path: Column) -> Column:
    """Segments without '' and '.', joined by '/'; null if a segment is '..' or the path holds a NUL."""
    parts = _segments(path)
    bad = F.array_contains(parts, "..") | F.contains(path, F.lit("\x00"))
    return F.when(~bad, F.array_join(parts, "/"))


def normalize_archive_path(path: Column) -> Column:
    """As normalize_path, and null for the root too: such archive members are skipped."""
    found = normalize_path(path)
    return F.when(found != "", found)


def collapse_dotdot(path: Column) -> Column:
    """Absolute path with '..' resolved; it can't climb above the root."""
    up = F.aggregate(_segments(path), F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(up, "/"))


def apply_cwd(cwd: Column, path: Column) -> Column:
    """Path as seen from the working directory; absolute paths stay."""
    base = F.rtrim(cwd, F.lit("/"))
    return F.when(path.startswith("/"), path).when(path == "", F.when(base == "", "/").otherwise(base)).otherwise(F.concat(base, F.lit("/"), path))


def split_ref(spec: Column) -> Column:
    """struct(ref, path) of 'ref:path': the colon isn't first and comes before any slash; else ref is null."""
    pattern = r"(?s)^([^:/]+):(.*)$"
    has = spec.rlike(pattern)
    return F.struct(F.when(has, F.regexp_extract(spec, pattern, 1)).alias("ref"), F.when(has, F.regexp_extract(spec, pattern, 2)).otherwise(spec).alias("path"))


def parent_of(path: Column) -> Column:
    """What stands before the last slash, or ''."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def join_child(parent: Column, name: Column) -> Column:
    return F.when(parent == "", name).otherwise(F.concat(parent, F.lit("/"), name))


def ancestors(path: Column) -> Column:
    """All strict ancestors of a normalised path, nearest last, without the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def strict_ancestors(path: Column) -> Column:
    """ancestors(), and the empty array for a single segment."""
    return F.when(F.contains(path, F.lit("/")), ancestors(path)).otherwise(F.array().cast("array<string>"))


def under(path: Column, directory: str) -> Column:
    """Whether a path is the directory or lies below it; '' is the root."""
    return F.lit(True) if directory == "" else (path == directory) | path.startswith(directory + "/")


def below(path: Column, directory: str) -> Column:
    return path != "" if directory == "" else path.startswith(directory + "/")


def strip_mount(path: Column, mount: str) -> Column:
    """'' at the mount, the rest below it, null elsewhere."""
    return F.when(path == mount, "").when(path.startswith(mount + "/"), F.substring(path, len(mount) + 2, 1 << 30))


def route(path: Column) -> Column:
    """struct(target, name, path): containers, container, workspace, peers or local."""
    n = F.ltrim(path, F.lit("/"))
    rest = lambda k: F.substring(n, k + 2, 1 << 30)
    box = rest(len("containers"))
    empty = F.lit(None).cast("string")
    as_ = lambda t, name, p: F.struct(F.lit(t).alias("target"), name.alias("name"), p.alias("path"))
    cut = F.locate("/", box)
    return (
        F.when(n.isin("containers", "containers/"), as_("containers", empty, empty))
        .when(n.startswith("containers/"), as_("container", F.substring_index(box, "/", 1), F.when(cut > 0, F.regexp_extract(box, r"(?s)^[^/]*/(.*)$", 1)).otherwise("")))
        .when((n == "workspace") | n.startswith("workspace/"), as_("workspace", empty, rest(len("workspace"))))
        .when((n == "peers") | n.startswith("peers/"), as_("peers", empty, rest(len("peers"))))
        .otherwise(as_("local", empty, n)))


def resolve_cd(cwd: Column, argument: Column) -> Column:
    """Absolute directory that a change of directory leads to."""
    return collapse_dotdot(apply_cwd(cwd, argument))
