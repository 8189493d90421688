"""Instances of running commands: state, listing, restarts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.functions.scalars import role_rank, wants_restart

#: Seconds of the first wait, of the longest wait, and of an attempt that counts as healthy.
FIRST_WAIT, LONGEST_WAIT, HEALTHY = 1, 60, 60


def running(instances: DataFrame, processes: DataFrame) -> DataFrame:
    """instances with `running`: the pid exists, and its start time is the one recorded if any was; an unreadable start fails."""
    alive = processes.select(F.col("pid").alias("_pid"), F.col("start").alias("_start"))
    joined = instances.join(alive, F.col("pid") == F.col("_pid"), "left")
    same = F.col("_pid").isNotNull() & (F.col("start").isNull() | F.coalesce(F.col("start") == F.col("_start"), F.lit(False)))
    return joined.withColumn("running", same).drop("_pid", "_start")


def status(running: Column, pid: Column, exit_code: Column) -> Column:
    return F.when(running, F.format_string("running (pid %d)", pid)).when(exit_code.isNotNull(), F.format_string("exited (%d)", exit_code)).when(pid.isNotNull(), "dead").otherwise("spawning")


def ps(instances: DataFrame, processes: DataFrame, everything: bool = False) -> DataFrame:
    """id, container, branch, status, restarts, started_unix; running ones only unless everything."""
    seen = running(instances, processes)
    seen = seen if everything else seen.where("running")
    restarts = F.coalesce("restarts", F.lit(0)) if "restarts" in instances.columns else F.lit(0)
    return seen.select("id", "container", "branch", status(F.col("running"), F.col("pid"), F.col("exit_code")).alias("status"), restarts.alias("restarts"), "started_unix")


def listed(rows: DataFrame) -> DataFrame:
    """Newest first, then by id."""
    return rows.orderBy(F.desc("started_unix"), "id")


def column_widths(rows: DataFrame) -> DataFrame:
    """One row with the widest value of every column."""
    return rows.agg(*[F.max(F.length(F.coalesce(F.col(c).cast("string"), F.lit("")))).alias(c) for c in rows.columns])


def deploy_matches(instances: DataFrame, container: str, branch: str) -> DataFrame:
    return instances.where((F.col("container") == container) & (F.col("branch") == branch))


def in_namespace(processes: DataFrame, namespaces: DataFrame) -> DataFrame:
    """pid, ascending, of processes whose namespace is among a container's."""
    return processes.join(namespaces.select("ns"), "ns", "left_semi").select("pid").orderBy("pid")


def backoff(attempts: DataFrame) -> DataFrame:
    """id, attempt, wait, restarts of attempts (id, attempt, up_seconds, exit_code, policy).

    Waits double from 1 s to 60 s and start again after a healthy attempt; a row's wait follows the attempt and is null where the
    policy stops. The wait of an attempt depends on how many unhealthy attempts precede it since the last healthy one, which
    a window over the attempts counts.
    """
    ordered = "PARTITION BY id ORDER BY attempt"
    stops = ~wants_restart(F.col("policy"), F.col("exit_code"))
    live = attempts.withColumn("_stop", stops).withColumn("_before", F.expr(f"coalesce(max(cast(_stop AS int)) OVER ({ordered} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")).where("_before = 0")
    spans = live.withColumn("_span", F.expr(f"sum(CASE WHEN up_seconds >= {HEALTHY} THEN 1 ELSE 0 END) OVER ({ordered})"))
    step = F.expr("row_number() OVER (PARTITION BY id, _span ORDER BY attempt) - 1")
    wait = F.least(F.pow(F.lit(2.0), F.least(step, F.lit(6))), F.lit(float(LONGEST_WAIT))).cast("int")
    done = spans.withColumn("wait", F.when(~F.col("_stop"), wait)).withColumn("restarts", F.expr(f"cast(sum(CASE WHEN _stop THEN 0 ELSE 1 END) OVER ({ordered}) AS int)"))
    return done.select("id", "attempt", "wait", "restarts")


def healthy(attempts: DataFrame, grace: int = 10) -> DataFrame:
    """id, healthy: within the gate's window (grace, 3 s at least) the first attempt neither exited nor restarted."""
    window = max(grace, 3)
    first = attempts.groupBy("id").agg(F.min(F.struct("attempt", "up_seconds", "exit_code")).alias("x"), F.count("*").alias("n"))
    return first.select("id", ((F.col("x.up_seconds") >= window) | (F.col("x.exit_code").isNull() & (F.col("n") == 1))).alias("healthy"))


def role_of(peers: DataFrame, keys: DataFrame) -> DataFrame:
    """pubkey, role of the asked keys; null for a key that no peer with a known role has, the first name if several do."""
    known = peers.where(role_rank(F.col("role")) > 0).groupBy("pubkey").agg(F.min_by("role", "name").alias("role"))
    return keys.select("pubkey").distinct().join(known, "pubkey", "left").select("pubkey", "role")


def container_status(containers: DataFrame) -> DataFrame:
    """container, status of (container, branch, head, changed): one line, with the first twelve digits of the head."""
    head = F.when(F.col("head").isNull(), "no commits").otherwise(F.substring("head", 1, 12))
    state = F.when(F.col("changed"), "modified").otherwise("clean")
    return containers.select("container", F.format_string("%s on %s at %s, %s", "container", F.coalesce("branch", F.lit("(detached)")), head, state).alias("status"))
