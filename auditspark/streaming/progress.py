"""Streaming: the event log, idempotent counting, snapshots and fan-out; what needs order is in ``ordered``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.candidates import keep_first
from ..schemas import EVENT


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT).parquet(path)


def append_events(events: DataFrame, path: str, checkpoint: str):
    """The log: every event, in files; replay orders by (timestamp, seq)."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def replay(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).parquet(path).orderBy("scan_id", "timestamp", "seq")


def stream_processed(processed: DataFrame, key: list[str], at: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Distinct processed keys a scan; with a time column duplicates are remembered within the watermark only."""
    once = processed.dropDuplicates(key) if at is None else processed.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)
    return once.groupBy("scan_id").agg(F.count(F.lit(1)).alias("processed"))


def snapshot_sink(path: str, session: str, model: str):
    """A foreachBatch function: the last snapshot of each session replaces the stored one, in a new folder a batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        keep_first(batch, [session, model], [F.desc("seq")]).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def fan_out(events: DataFrame, consumers: dict[str, str], checkpoint: str) -> list:
    """One query a consumer: its name and the folder that it reads."""
    return [append_events(events, path, f"{checkpoint}/{name}").queryName(name) for name, path in consumers.items()]


def consumer_progress(spark: SparkSession, checkpoint: str, consumers: list[str]) -> DataFrame:
    """``(consumer, batch)``: the last batch that each consumer has finished, null before the first; each goes on from there
    after a restart, whatever the others do."""
    found = []
    for name in consumers:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/{name}/commits")
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        found.append((name, max((int(n) for n in names if n.isdigit()), default=None)))
    return spark.createDataFrame(found, "consumer string, batch long")
