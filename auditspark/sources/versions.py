"""A stored table that changes by upserts: buckets in folders, and a commit file a version that names each bucket's folder.

Rows lie in ``buckets`` by a hash of their key. An upsert reads and writes only the buckets that its changes touch, into a new
folder; then one commit file makes it the next version. Readers follow the last commit, so they see a version whole or not at
all: what a crash leaves behind no commit names, and ``vacuum`` removes it. Two writers that start from one version write the
same commit name; one of them wins, and the other begins again on the new version. A change that has an id is applied once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.candidates import upsert
from .writers import _fs

#: Ids of changes that a version remembers, and tries of a writer that others overtake.
REMEMBERED = 1000
TRIES = 20


def last_commit(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the last version: 0 and no buckets if there is none."""
    folder, fs, _ = _fs(spark, f"{path.rstrip('/')}/_commits")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")]
    if not numbers:
        return 0, {"buckets": {}, "applied": []}
    name = f"{folder}/{max(numbers):020d}.json"
    return max(numbers), json.loads(spark.read.option("wholetext", True).text(name).first()[0])


def commit(spark: SparkSession, path: str, number: int, content: dict) -> bool:
    """Whether the content became this version: written beside, then renamed, which fails if another writer was first."""
    target, fs, jvm = _fs(spark, f"{path.rstrip('/')}/_commits/{number:020d}.json")
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    out = fs.create(beside, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    # Some file systems let a rename replace a file.
    if not fs.exists(target) and fs.rename(beside, target):
        return True
    fs.delete(beside, False)
    return False


def read_stored(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame | None:
    """The last version, or some of its buckets; None if there is no version."""
    number, content = last_commit(spark, path)
    return _read(spark, path, content, buckets) if number else None


def _read(spark: SparkSession, path: str, content: dict, buckets: list[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(content["schema"])
    folders = [f"{path.rstrip('/')}/{folder}" for b, folder in content["buckets"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert_stored(changes: DataFrame, path: str, key: list[str], order: str = "seq", buckets: int = 64, change_id: str | None = None) -> int:
    """Changes take the place of stored rows of the same key, the last by ``order`` first; the number of the new version, or
    of the last one if it holds a change of this id already. A table keeps the number of buckets that it began with."""
    spark, path = changes.sparkSession, path.rstrip("/")
    for _ in range(TRIES):
        number, content = last_commit(spark, path)
        if change_id is not None and change_id in content["applied"]:
            return number
        n = content.get("n", buckets)
        bucket = F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")
        # At most n numbers.
        touched = [r[0] for r in changes.select(bucket).distinct().collect()]
        stored = _read(spark, path, content, touched) if number else changes.limit(0)
        merged = upsert(stored.select(*changes.columns), changes, key, order)
        folder = f"data/{uuid.uuid4().hex}"
        merged.withColumn("_bucket", bucket).write.partitionBy("_bucket").parquet(f"{path}/{folder}")
        after = content["buckets"] | {str(b): f"{folder}/_bucket={b}" for b in touched}
        applied = [*content["applied"], *([change_id] if change_id is not None else [])][-REMEMBERED:]
        if commit(spark, path, number + 1, {"n": n, "schema": json.loads(changes.schema.json()), "buckets": after, "applied": applied}):
            return number + 1
        _delete(spark, f"{path}/{folder}")
    raise RuntimeError(f"other writers came first {TRIES} times")


def _delete(spark: SparkSession, path: str) -> None:
    target, fs, _ = _fs(spark, path)
    fs.delete(target, True)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete folders that the last version does not name, and count them. Not beside a writer or a reader of an older
    version."""
    path = path.rstrip("/")
    _, content = last_commit(spark, path)
    named = {folder.rsplit("/", 1)[0] for folder in content["buckets"].values()}
    root, fs, _ = _fs(spark, f"{path}/data")
    gone = [s.getPath().getName() for s in fs.listStatus(root) if f"data/{s.getPath().getName()}" not in named] if fs.exists(root) else []
    for name in gone:
        _delete(spark, f"{path}/data/{name}")
    return len(gone)
