"""Event logs of scans: ordered replay, the phase machine, monotone counters, snapshots and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .candidates import keep_first

#: Phases in the order in which a scan can only go forward.
PHASES = ("pending", "analyzing", "auditing", "completed", "error", "cancelled")
TERMINAL = ("completed", "error", "cancelled")


def phase_rank(phase: Column) -> Column:
    """0 pending, 1 analyzing, 2 auditing, 3 any end; unknown phases count as pending."""
    return F.when(phase.isin("analyzing", "static_analysis"), 1).when(phase == "auditing", 2).when(phase.isin(*TERMINAL), 3).otherwise(0)


def scan_states(events: DataFrame, key: str = "scan_id", order: str = "seq") -> DataFrame:
    """State of each scan after all its events: status never goes back, the first end stays, the static-analysis flag is
    never cleared. A grouped maximum, combined before the shuffle."""
    rank = phase_rank(F.col("phase"))
    first_end = F.min_by("phase", F.when(rank == 3, F.col(order)))
    return events.groupBy(key).agg(
        F.max(rank).alias("_rank"), first_end.alias("_end"), F.bool_or(rank >= 2).alias("static_done"), F.count(F.lit(1)).alias("n_events"), F.max_by("message", order).alias("last_message")
    ).select(key, F.when(F.col("_rank") == 3, F.col("_end")).when(F.col("_rank") == 2, "auditing").when(F.col("_rank") == 1, "analyzing").otherwise("pending").alias("status"), "static_done", "n_events", "last_message")


def status_history(events: DataFrame, key: str = "scan_id", order: str = "seq") -> DataFrame:
    """Events with the status that holds after each."""
    over = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = F.max(phase_rank(F.col("phase"))).over(over)
    return events.withColumn("status_rank", rank)


def processed_counts(processed: DataFrame, stored: DataFrame, key: str, item) -> DataFrame:
    """Distinct processed items a scan, never below the stored count."""
    counted = processed.dropDuplicates([key, *item]).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return stored.join(counted, key, "left").withColumn("processed", F.greatest(F.coalesce("_n", F.lit(0)), F.coalesce("processed", F.lit(0)))).drop("_n")


def latest_snapshots(known: DataFrame, snapshots: DataFrame, session: str, model: str, order: str = "seq") -> DataFrame:
    """Last snapshot of each session wins; known models that it leaves out are disabled."""
    last = snapshots.groupBy(session).agg(F.max(order).alias(order))
    current = keep_first(snapshots.join(last, [session, order]), [session, model], [F.desc(order)]).withColumn("enabled", F.lit(True))
    return known.select(session, model).distinct().join(current, [session, model], "full").withColumn("enabled", F.coalesce("enabled", F.lit(False)))


def settled(scans: DataFrame, transient: list[str]) -> DataFrame:
    """Scans that ended lose their transient counters and keep the rest."""
    return scans.withColumns({c: F.when(F.col("status").isin(*TERMINAL), F.lit(0)).otherwise(F.col(c)) for c in transient})


def reports_to_send(snapshots: DataFrame, key: str, at: str, signature: str, heartbeat_seconds: int = 60) -> DataFrame:
    """Snapshots that differ from the one before, or come a heartbeat after it."""
    over = Window.partitionBy(key).orderBy(at)
    before, then = F.lag(signature).over(over), F.lag(at).over(over)
    gap = F.unix_timestamp(F.col(at)) - F.unix_timestamp(then)
    return snapshots.withColumn("_send", before.isNull() | (before != F.col(signature)) | (gap >= heartbeat_seconds)).filter("_send").drop("_send")


def reconcile_offline(rows: DataFrame, dead: DataFrame, agent: str, status: str, running, ended: str) -> DataFrame:
    """Rows of dead agents that are still running get the status ``ended``."""
    gone = dead.select(agent).distinct().withColumn("_dead", F.lit(True))
    out = rows.join(gone, agent, "left")
    return out.withColumn(status, F.when(F.col("_dead") & F.col(status).isin(*running), ended).otherwise(F.col(status))).drop("_dead")


def lease_totals(leases: DataFrame, key: str = "model_id") -> DataFrame:
    """Running, finished and failed leases and the time they took, from acquire and release events."""
    end = F.col("kind") == "release"
    return leases.groupBy(key).agg((F.count_if(F.col("kind") == "acquire") - F.count_if(end)).alias("running"), F.count_if(end & (F.col("outcome") == "success")).alias("success"), F.count_if(end & (F.col("outcome") != "success")).alias("failed"), F.sum(F.when(end, F.col("duration_ms")).otherwise(0)).alias("duration_ms"))


def continuation(scans: DataFrame, retried: DataFrame, processed: DataFrame, key) -> tuple[DataFrame, DataFrame]:
    """Scans with their offset, total less what remains, and processed keys without the retried ones."""
    offset = F.greatest(F.col("total") - F.col("remaining"), F.lit(0))
    return scans.withColumn("offset", offset), processed.join(retried.select(*key).distinct(), list(key), "left_anti")


def queue_order(status: str = "status", at: str = "timestamp") -> list[Column]:
    """Running, queued and planned tasks, oldest first; then ended ones, newest first; without a time last."""
    rank = F.when(F.col(status) == "running", 0).when(F.col(status) == "queued", 1).when(F.col(status) == "planned", 2).otherwise(3)
    seconds = F.unix_timestamp(F.col(at))
    return [rank.asc(), F.when(rank >= 3, -seconds).otherwise(seconds).asc_nulls_last()]


def model_order() -> list[Column]:
    """By capability, load in proportion to weight, load, weight, last use, id."""
    return [F.col("capability").asc(), (F.col("running") / F.col("weight")).asc(), F.col("running").asc(), F.col("weight").desc(), F.col("last_used").asc_nulls_first(), F.col("id").asc()]
