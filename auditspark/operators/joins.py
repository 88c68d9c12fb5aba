"""Joins with one fact a key, where some keys may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with so many rows is heavy; of n rows at most n / max(HUB, n / MAX_HUBS) keys are, so at most MAX_HUBS.
HUB = 256
MAX_HUBS = 4096
#: Rows that a task sorts, some, where their number is known; and rows that hold arrays.
ROWS = 1_000_000
WIDE_ROWS = 250_000
#: Facts of a key, a path and a name or so each, that are sent to all tasks: some 10 MB.
FEW_FACTS = 100_000


def dealt(rows: DataFrame, keys: list[str], total: int, most: int) -> DataFrame:
    """``rows``, of which there are ``total``, dealt by their keys so that a task gets some ``most`` rows.

    A session has a fixed number of shuffle partitions, so what a task sorts would grow with the input. Where these are enough,
    rows stay as they are, for Spark to deal and coalesce. A join or window over the keys keeps these partitions.
    """
    n = -(-total // most)
    return rows.repartition(n, *keys) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def join_fact(rows: DataFrame, facts: DataFrame, keys: list[str], total: int, how: str = "left") -> DataFrame:
    """``rows`` with the columns of ``facts``, which has at most one row a key.

    Rows of heavy keys meet their few facts, at most MAX_HUBS, by a broadcast and stay where they are; the rest is shuffled.
    total: how many rows there are. A null key meets nothing.
    """
    facts, hub = facts.withColumn("_has", F.lit(True)), max(HUB, total // MAX_HUBS)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies")).filter(F.col("_copies") >= hub).drop("_copies")
    heavy = F.broadcast(counts.join(facts, keys, "left").withColumn("_heavy", F.lit(True)))
    met = rows.join(heavy, keys, "left")
    light = met.filter("_heavy is null").drop("_heavy", *(c for c in facts.columns if c not in keys)).join(facts, keys, "left")
    out = met.filter("_heavy").drop("_heavy").unionByName(light)
    return (out.filter("_has") if how == "inner" else out).drop("_has")
