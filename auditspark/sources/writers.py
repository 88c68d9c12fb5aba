"""Sinks: index tables with a completeness marker, replacement of a scan, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fence, safe_filename
from ..operators.candidates import dense_index


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_index(tables: dict[str, DataFrame], path: str, indexer: str) -> None:
    """Write all tables beside the target and move them there once they are complete; the marker is part of them.

    The index that stands there is moved aside, not deleted, until the new one is in its place: a crash in between leaves
    both, and recover_index puts the old one back.
    """
    spark = next(iter(tables.values())).sparkSession
    path = path.rstrip("/")
    recover_index(spark, path)
    staging = f"{path}.{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.parquet(f"{staging}/{name}")
    spark.range(1).select(F.lit("complete").alias("status"), F.lit(indexer).alias("indexer"), F.current_timestamp().alias("completed_at")).write.parquet(f"{staging}/_meta.parquet")
    target, fs, jvm = _fs(spark, path)
    old = jvm.org.apache.hadoop.fs.Path(f"{path}.old")
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), target):
        raise OSError(f"could not move {staging} to {path}")
    fs.delete(old, True)


def recover_index(spark: SparkSession, path: str) -> None:
    """After a crash: an index that was moved aside goes back if there is no new one, else it is dropped."""
    target, fs, jvm = _fs(spark, path)
    old = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old")
    if fs.exists(old):
        if fs.exists(target):
            fs.delete(old, True)
        else:
            fs.rename(old, target)


def index_complete(spark: SparkSession, path: str, indexer: str) -> bool:
    target, fs, jvm = _fs(spark, f"{path}/_meta.parquet")
    return fs.exists(target) and bool(spark.read.parquet(f"{path}/_meta.parquet").filter((F.col("status") == "complete") & (F.col("indexer") == indexer)).take(1))


def replace_scan(findings: DataFrame, path: str, order, scans: DataFrame | None = None, buckets: int = 64) -> None:
    """Findings replace what is stored of the scans in ``scans(scan_id)`` (by default those in ``findings``); a scan without
    any is emptied; others stay. Indexes are dense.

    Scans lie in ``buckets`` folders by a hash; only the folders that hold a replaced scan are written again.
    """
    spark = findings.sparkSession
    bucket = F.pmod(F.xxhash64(F.col("scan_id")), F.lit(buckets)).cast("int")
    rows = dense_index(findings, ["scan_id"], order).withColumn("bucket", bucket)
    scans = (findings if scans is None else scans).select("scan_id").distinct()
    target, fs, jvm = _fs(spark, path)
    if fs.exists(target):
        touched = [r[0] for r in scans.select(bucket).distinct().collect()]
        stored = spark.read.parquet(path).filter(F.col("bucket").isin(touched)).join(scans, "scan_id", "left_anti")
        # Written beside first: a folder cannot be read while it is replaced.
        beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
        stored.unionByName(rows, allowMissingColumns=True).write.partitionBy("bucket").parquet(beside)
        moved = spark.read.schema(rows.schema).parquet(beside)
        moved.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        # A folder whose scans are all empty now has no new rows to replace it.
        kept = {r[0] for r in moved.select("bucket").distinct().collect()}
        for b in set(touched) - kept:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}"), True)
        fs.delete(jvm.org.apache.hadoop.fs.Path(beside), True)
    else:
        rows.write.partitionBy("bucket").parquet(path)


def markdown(findings: DataFrame) -> DataFrame:
    """``(file_name, content)`` a finding."""
    mark = fence(F.coalesce("description", F.lit("")))
    content = F.concat_ws("\n", F.concat(F.lit("# "), F.col("vuln_type"), F.lit(": "), F.col("function")), F.lit(""), F.concat(F.lit("* place: "), F.col("file"), F.lit(":"), F.col("line").cast("string")), F.concat(F.lit("* severity: "), F.coalesce("severity", F.lit("unknown"))), F.concat(F.lit("* verdict: "), F.coalesce(F.nullif("ai_verdict", F.lit("")), F.lit("none"))), F.lit(""), mark, F.coalesce("description", F.lit("")), mark, F.lit(""))
    scan = [safe_filename(F.col("scan_id").cast("string")), F.lit("-")] if "scan_id" in findings.columns else []
    name = F.concat(*scan, F.lpad(F.col("idx").cast("string"), F.greatest(F.lit(4), F.length(F.col("idx").cast("string"))), F.lit("0")), F.lit("-"), safe_filename(F.concat_ws("-", "vuln_type", "function")), F.lit(".md"))
    return findings.select(name.alias("file_name"), content.alias("content"))


def export_markdown(findings: DataFrame, path: str, buckets: int = 64) -> None:
    """Pages as rows of text files: a page is the text below a line that names it, pages lie in ``buckets`` folders by a hash
    of their name; an index beside them."""
    pages = markdown(findings)
    bucket = F.pmod(F.xxhash64("file_name"), F.lit(buckets)).cast("int")
    pages.select(bucket.alias("bucket"), F.concat(F.lit("<!-- "), "file_name", F.lit(" -->\n"), "content").alias("value")).write.mode("overwrite").partitionBy("bucket").text(f"{path}/findings")
    pages.select(F.concat(F.lit("* "), F.col("file_name")).alias("value")).orderBy("value").write.mode("overwrite").text(f"{path}/index")


def candidates_json(candidates: DataFrame, indent: int = 2) -> DataFrame:
    """``value``: the candidates in order of seq as the lines of one indented JSON array, text as it is.

    Each candidate is an element with its comma; the brackets are rows of their own, so no row holds the whole.
    """
    pad = " " * indent
    # An object of one line a field; to_json escapes what a field's text holds.
    fields = [c for c in candidates.columns if c != "seq"]
    lines = [F.concat(F.lit(f'{pad * 2}"{c}": '), F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":([\s\S]*)\}$', 1), F.lit("null"))) for c in fields]
    last = candidates.agg(F.max("seq")).first()[0]
    body = F.concat(F.lit(f"{pad}{{\n"), F.array_join(F.array(*lines), ",\n"), F.lit(f"\n{pad}}}"), F.when(F.col("seq") == last, "").otherwise(","))
    spark = candidates.sparkSession
    ends = spark.createDataFrame([(0, 0, "["), (2, 0, "]")], "part int, seq long, value string")
    return ends.unionByName(candidates.select(F.lit(1).alias("part"), F.col("seq").cast("long").alias("seq"), body.alias("value"))).orderBy("part", "seq").select("value")


def export_candidates(candidates: DataFrame, path: str) -> None:
    """One JSON object a line, for reading back."""
    candidates.write.mode("overwrite").json(path)


def export_json_array(candidates: DataFrame, path: str) -> None:
    """Text files whose parts, in order of their names, are one indented JSON array."""
    candidates_json(candidates).write.mode("overwrite").text(path)
