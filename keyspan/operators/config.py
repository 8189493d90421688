"""Configuration as rows: profiles over a base, overrides, and steps already applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.schema import content_hash


class ConfigError(ValueError):
    """A profile or field that doesn't hold."""


def overlay(base: DataFrame, profiles: DataFrame, on: list[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """base with each field replaced by the profile's where that has one, then by the default; lists and maps are replaced whole."""
    fields = [c for c in base.columns if c not in on]
    p = profiles.select(*on, *[(F.col(c) if c in profiles.columns else F.lit(None)).alias(f"_p_{c}") for c in fields])
    value = lambda c: F.coalesce(f"_p_{c}", c, F.lit(defaults[c])) if defaults and c in defaults else F.coalesce(f"_p_{c}", c)
    return base.join(p, on, "left").select(*on, *[value(c).alias(c) for c in fields])


def pick_profile(profiles: DataFrame, name: str, column: str = "profile") -> DataFrame:
    """The profile's rows; an unknown name is refused with the names there are."""
    found = profiles.where(F.col(column) == name)
    if found.isEmpty():
        names = profiles.select(F.expr(f"listagg(DISTINCT {column}, ', ') WITHIN GROUP (ORDER BY {column})")).first()[0]
        raise ConfigError(f"no profile {name!r}; there are: {names}")
    return found


def merged_env(base: Column, override: Column) -> Column:
    """Union of two maps; the override's entries win."""
    extra = F.coalesce(override, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(F.coalesce(base, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(extra, k))
    return F.map_concat(kept, extra)


def passed_env(base: Column, more: Column) -> Column:
    """base and those of more that it lacks."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(base, none), F.coalesce(more, none))


def problems(configs: DataFrame) -> DataFrame:
    """configs that don't hold, with the reason: an image is needed and not blank, a run command isn't empty."""
    reason = F.when(F.coalesce(F.trim("image"), F.lit("")) == "", "image is required").when(F.col("run").isNotNull() & (F.size("run") == 0), "run is empty").when(F.exists("run", lambda x: F.trim(x) == ""), "run has a blank word")
    return configs.withColumn("problem", reason).where("problem IS NOT NULL")


def pending_steps(steps: DataFrame, applied: DataFrame) -> DataFrame:
    """Steps (position, step) whose hash isn't among applied (hash), with their hash; each text once, at its first position."""
    first = steps.groupBy("step").agg(F.min("position").alias("position")).withColumn("hash", content_hash(F.col("step")))
    return first.join(applied.select("hash"), "hash", "left_anti").select("position", "step", "hash")


def parse_session(lines: DataFrame, container: str = "main") -> DataFrame:
    """One row container, cwd from text lines (position, value): k=v, '#' comments; the last of a key counts."""
    kv = lines.select("position", F.trim("value").alias("v")).where("v <> '' AND NOT startswith(v, '#') AND contains(v, '=')").select("position", F.substring_index("v", "=", 1).alias("k"), F.expr("substring(v, locate('=', v) + 1)").alias("x"))
    last = lambda k, d: F.coalesce(F.nullif(F.max_by(F.when(F.col("k") == k, F.col("x")), F.when(F.col("k") == k, F.col("position"))), F.lit("")), F.lit(d)).alias(k)
    return kv.agg(last("container", container), last("cwd", "/"))
