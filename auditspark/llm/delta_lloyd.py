"""Clustering by Delta Lloyd: assignments and global sums persist, and each round moves only what changes.

Vectors of whole numbers are packed into blocks, one row a block, with the owner of each vector and its squared distance. The
driver holds the centroids and the global sum and count of each (a bounded number of whole numbers). A round compares

* vectors whose owner's centroid changed with all centroids, since their own distance is no longer known, and
* all other vectors with the changed centroids only: what they were not nearest to before has not come nearer.

A block returns signed transfers: for each centroid the vectors gained less those lost, summed in the block before anything is
shuffled. Adding them to the global sums gives the new centroids exactly. Each round is a written table that replaces the
last one, so a lost executor costs the tasks it held. Nothing but transfers, some 16 rows a block, is shuffled.

Defined results: vectors that are null, of another length, or hold a null or non-finite component are left out. Of rows that
tie in the order of first centroids (a repeated vec_id) the least vector comes first; a null vec_id comes last. Fewer vectors
than centroids make fewer centroids. Repeated rows each get a row; an empty table gives an empty result; other columns are
ignored. Squared distances beyond a long are compared exactly and given as the greatest long; so are sums of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_or_null, forget, materialize
from .integer_vectors import EXACT, largest, pack_ints, rows_of, unpack_ints, usable, whole

#: Vectors of a block.
BLOCK = 4096
LONG = (1 << 63) - 1
STATE = "ids binary, known binary, vectors binary, owner binary, distance binary, moved array<struct<cluster:int,n:long,sums:array<decimal(38,0)>>>"
NAMES = ["ids", "known", "vectors", "owner", "distance", "moved"]
_SUMS = pa.list_(pa.decimal128(38, 0))
_MOVED = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", _SUMS)]))


def squared(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to each centroid: as int64 where all fit, else as Python's numbers."""
    n, dim = x.shape
    most = largest(x)
    columns: list[np.ndarray] = []
    narrow = [i for i, c in enumerate(centroids) if 4 * dim * max(most, *map(abs, c)) ** 2 < EXACT]
    if narrow:
        c = np.array([centroids[i] for i in narrow], np.float64)
        f = x.astype(np.float64)
        near = ((f * f).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None] - 2 * (f @ c.T)).astype(np.int64)
        if len(narrow) == len(centroids):
            return near
    for i, c in enumerate(centroids):
        if i in narrow:
            columns.append(near[:, narrow.index(i)].astype(object))
        else:
            gap = x.astype(object) - np.array(c, object)[None]
            columns.append((gap * gap).sum(axis=1) if n else np.zeros(0, object))
    return np.stack(columns, axis=1)


def assign(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: list[list[int]], changed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """New owners and their squared distances; ties go to the smaller number. A distance below 0 is not known."""
    owner, best = owner.copy(), distance.copy()
    again = np.isin(owner, changed) | (owner < 0) | (distance < 0)
    at = np.flatnonzero(again)
    if len(at):
        d = squared(x[at], centroids)
        best = best.astype(d.dtype)
        owner[at] = d.argmin(axis=1)
        best[at] = d.min(axis=1)
    at = np.flatnonzero(~again)
    if len(at) and changed:
        d = squared(x[at], [centroids[c] for c in changed])
        best = best.astype(object) if d.dtype == object else best
        who, least = np.array(changed)[d.argmin(axis=1)], d.min(axis=1)
        better = (least < best[at]) | ((least == best[at]) & (who < owner[at]))
        owner[at[better]], best[at[better]] = who[better], least[better]
    return owner, best


def transfers(x: np.ndarray, before: np.ndarray, after: np.ndarray, k: int) -> list[dict]:
    """Signed counts and sums of what each centroid gains and loses."""
    out = []
    moved = np.flatnonzero(before != after)
    fits = largest(x) < LONG // max(1, len(x))
    x, before, after = x[moved], before[moved], after[moved]
    for c in range(k):
        gain, loss = after == c, before == c
        if gain.any() or loss.any():
            y = x if fits else x.astype(object)
            sums = y[gain].sum(axis=0) - y[loss].sum(axis=0)
            out.append({"cluster": c, "n": int(gain.sum()) - int(loss.sum()), "sums": [Decimal(int(s)) for s in sums]})
    return out


def _record(ids: bytes, known: bytes, vectors: bytes, owner: np.ndarray, distance: np.ndarray, moved: list[dict]) -> pa.RecordBatch:
    binary = [ids, known, vectors, owner.astype("<i4").tobytes(), distance.astype("<i8").tobytes()]
    return pa.RecordBatch.from_arrays([*(pa.array([b], pa.binary()) for b in binary), pa.array([moved], _MOVED)], NAMES)


def _blocks(scale: float, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, held = [], [], 0

        def out() -> pa.RecordBatch:
            x, some = np.concatenate(vectors), pa.concat_arrays(ids)
            known = some.is_valid().to_numpy(zero_copy_only=False)
            return _record(some.fill_null(0).to_numpy().astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), pack_ints(x), np.full(len(x), -1), np.full(len(x), -1), [])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids.append(part.column(0))
                vectors.append(whole(rows_of(part.column(1))[0], scale).reshape(-1, dim))
                held += part.num_rows
                if held >= BLOCK:
                    yield out()
                    ids, vectors, held = [], [], 0
        if held:
            yield out()

    return run


def _round(centroids: list[list[int]], changed: list[int], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, known, vectors, owner, distance in zip(*(c.to_pylist() for c in batch.columns[:5])):
                x = unpack_ints(vectors).reshape(-1, dim)
                before = np.frombuffer(owner, "<i4").astype(np.int64)
                after, best = assign(x, before, np.frombuffer(distance, "<i8"), centroids, changed)
                kept = np.array([d if d <= LONG else -1 for d in best.tolist()], np.int64)
                yield _record(ids, known, vectors, after, kept, transfers(x, before, after, len(centroids)))

    return run


def _result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, known, owner, distance in zip(*(c.to_pylist() for c in batch.columns)):
            distance = np.frombuffer(distance, "<i8")
            yield pa.RecordBatch.from_arrays([
                pa.array(np.frombuffer(ids, "<i8"), mask=np.frombuffer(known, np.uint8) == 0), pa.array(np.frombuffer(owner, "<i4")), pa.array(np.where(distance < 0, LONG, distance))
            ], ["vec_id", "cluster", "distance"])


def delta_lloyd(rows: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, salt: str = "1") -> DataFrame:
    """One row per usable vector of ``rows(vec_id, embedding)``: vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256."""
    spark = rows.sparkSession
    rows = rows.select(column_or_null(rows, "vec_id", "long").alias("vec_id"), column_or_null(rows, "embedding", "array<double>").alias("embedding"))
    rows = rows.filter(usable("embedding") & (F.size("embedding") == dim))
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(order.alias("place"), "embedding").orderBy(F.col("place").asc_nulls_last(), "embedding").limit(k).collect()
    centroids = [whole(np.array(r.embedding), scale).tolist() for r in first]
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    counts, sums = [0] * k, [[0] * dim for _ in range(k)]
    state, changed = materialize(rows.mapInArrow(_blocks(scale, dim), STATE), "lloyd-blocks"), list(range(k))
    for last in [False] * rounds + [True]:
        after = materialize(state.mapInArrow(_round(centroids, changed, dim), STATE), "lloyd-state")
        forget(state)
        state = after
        if last:
            break
        moved = state.select(F.explode("moved").alias("m")).select("m.cluster", "m.n", F.posexplode("m.sums").alias("place", "value"))
        # The count comes with the first component.
        total = moved.groupBy("cluster", "place").agg(F.sum("value").alias("value"), F.sum("n").alias("n")).collect()
        for r in total:
            sums[r.cluster][r.place] += int(r.value)
            if r.place == 0:
                counts[r.cluster] += r.n
        new = [[s // n for s in of] if n else old for of, n, old in zip(sums, counts, centroids)]
        changed = [c for c in range(k) if new[c] != centroids[c]]
        centroids = new
        if not changed:
            break
    found = state.select("ids", "known", "owner", "distance").mapInArrow(_result, "vec_id long, cluster int, distance long")
    inertia = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = [(c, min(v, LONG), min(sum(inertia.values()), LONG), sha[c]) for c, v in sorted(inertia.items())]
    # At most k rows.
    return found.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
