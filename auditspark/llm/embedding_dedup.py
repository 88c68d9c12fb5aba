"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Each unit vector x is stored as x = s q + e with int8 components q, a scale s and the exact length of the error e. Then
<x, y> differs from s_x s_y <q_x, q_y> by at most |s_x q_x| |e_y| + |e_x|, so a tile product of int8 matrices gives an
upper bound of every cosine; only pairs whose bound reaches the threshold are computed again in double precision.

Equal vectors are folded into one node first, by label and a 128-bit hash. Nodes are sorted by label and by the angle to a
fixed direction by a range shuffle, which also splits a hot label over many tasks, and cut into tiles and groups of tiles;
tiles of one label whose balls (centre and angular radius) lie too far apart to hold a link are never multiplied. Pairs of
groups are the units of work: a unit's task holds the tiles of one group and streams those of the other past them, so a
tile is moved once for each group that it may meet, not for each tile. Each product returns link counts and a spanning
forest, never all pairs.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component, and one with a null label,
links with nothing. Vectors of different lengths never link. Rows that repeat a vec_id are vectors of their own, and
such an id joins nothing. A null vec_id never names a component. Repeated rows each get a row; an empty table gives an
empty result; other columns are ignored. A cosine equal to the threshold links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_or_null, components_of_pairs, connected_components, join_split, materialize

TILE = 2048
#: Tiles of a group, so many bytes of vectors at most, and rows and columns over which the pairs of a label's groups are dealt.
GROUP = 16
GROUP_BYTES = 1 << 26
DEALS = 8
EPS = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 components, scales and upper bounds of the errors' lengths of unit row vectors."""
    scale = np.maximum(np.abs(unit).max(axis=1), 1e-300) / 127.0
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - q * scale[:, None], axis=1) * (1 + 1e-12) + 1e-15
    return q, scale, error


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows: float32 holds every sum below 2**24, float64 those of longer vectors."""
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return a.astype(kind) @ b.astype(kind).T


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that the greatest component is near one: nothing is rounded, and lengths neither vanish
    nor overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of x and y (doubles, not zero) whose cosine is at least the threshold."""
    x, y = scaled(x), scaled(y)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    qx, sx, ex = quantise(x / nx[:, None])
    qy, sy, ey = quantise(y / ny[:, None])
    bound = product(qx, qy) * (sx[:, None] * sy[None, :])
    bound += (1 + ex)[:, None] * ey[None, :] + ex[:, None]
    i, j = np.nonzero(bound >= threshold - EPS)
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        keep[at : at + (1 << 16)] = np.einsum("nd,nd->n", x[p], y[q]) / (nx[p] * ny[q]) >= threshold
    return i[keep], j[keep]


def packed(x: np.ndarray) -> bytes:
    """Vectors without loss: as float32 where that holds every value, which halves what is moved."""
    narrow = x.astype(np.float32)
    return b"4" + narrow.tobytes() if np.array_equal(narrow, x) else b"8" + x.tobytes()


def unpacked(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.float32 if data[:1] == b"4" else np.float64, offset=1).astype(np.float64).reshape(-1, dim)


def _tiles(size: int, group: int):
    """Tiles of at most ``size`` consecutive vectors of one label and length; a group is named by its first vector's node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["label", "dim", "grp", "tile", "centre", "radius", "ids", "copies", "vectors"]

        def record(label, dim, grp, ids, copies, vectors):
            x = np.frombuffer(b"".join(vectors), np.float64).reshape(-1, dim)
            unit = scaled(x)
            unit = unit / np.linalg.norm(unit, axis=1)[:, None]
            centre = unit.mean(axis=0)
            length = np.linalg.norm(centre)
            centre = centre / length if length > 1e-12 else unit[0]
            radius = float(np.arccos(np.clip((unit @ centre).min(), -1, 1))) + 1e-6
            return pa.RecordBatch.from_arrays([
                pa.array([label], pa.int64()), pa.array([dim], pa.int32()), pa.array([grp], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([centre.tobytes()], pa.binary()), pa.array([radius]),
                pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.array(copies, np.int64).tobytes()], pa.binary()), pa.array([packed(x)], pa.binary()),
            ], names)

        key, grp, tiles, ids, copies, vectors = None, None, 0, [], [], []
        for batch in batches:
            lists = batch.column(4)
            for label, dim, node, n, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), lists):
                if ids and (key != (label, dim) or len(ids) == size):
                    yield record(*key, grp, ids, copies, vectors)
                    tiles += 1
                    ids, copies, vectors = [], [], []
                if key != (label, dim) or tiles >= max(1, min(group, GROUP_BYTES // (8 * size * dim))):
                    grp, tiles = node, 0
                key = (label, dim)
                ids.append(node)
                copies.append(n)
                vectors.append(row.values.to_numpy(zero_copy_only=False).astype(np.float64).tobytes())
        if ids:
            yield record(*key, grp, ids, copies, vectors)

    return run


TILES = "label long, dim int, grp long, tile long, centre binary, radius double, ids binary, copies binary, vectors binary"


def far(angle: float, a: dict, b: dict) -> bool:
    """Whether no vector of a tile (or group) can lie within the angle of one of the other."""
    x, y = np.frombuffer(a["centre"]), np.frombuffer(b["centre"])
    return float(np.arccos(np.clip(x @ y, -1.0, 1.0))) > a["radius"] + b["radius"] + angle + 1e-6


def _group_pairs(angle: float):
    """(label, dim, a, b) of the groups in a cell that may hold links: those of side 0 are held, those of side 1 go past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                here = (row["label"], row["dim"], row["i"], row["j"])
                if cell != here:
                    cell, held = here, []
                if row["side"] == 0:
                    held.append(row)
                if row["side"] == 1 or row["i"] == row["j"]:
                    out += [(*here[:2], x["grp"], row["grp"]) for x in held if x["grp"] == row["grp"] or not far(angle, x, row)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["label", "dim", "a", "b"])

    return run


def groups_of(tiles: DataFrame) -> DataFrame:
    """One row a group: a ball around its first tile's centre that holds the balls of all its tiles."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        centre = np.frombuffer(rows[0]["centre"])
        radius = max(float(np.arccos(np.clip(np.frombuffer(r["centre"]) @ centre, -1.0, 1.0))) + r["radius"] for r in rows) + 1e-6
        return pa.table({"label": [rows[0]["label"]], "dim": pa.array([rows[0]["dim"]], pa.int32()), "grp": [rows[0]["grp"]], "centre": pa.array([centre.tobytes()], pa.binary()), "radius": [radius]})

    # GROUP rows a group at most.
    return tiles.select("label", "dim", "grp", "centre", "radius").groupBy("label", "dim", "grp").applyInArrow(run, "label long, dim int, grp long, centre binary, radius double")


def _multiply(threshold: float):
    """Units of work, sorted: the tiles of a unit's group a come before those of its group b. Within one group each tile
    meets itself and those before it."""
    angle = float(np.arccos(threshold))

    def links(a: dict, b: dict, same: bool) -> pa.RecordBatch | None:
        i, j = linked(a["x"], b["x"], threshold)
        if same:
            keep = i != j
            degree = np.bincount(i[keep], a["n"][j[keep]], len(a["x"])).astype(np.int64)
            ids = a["nodes"]
        else:
            ids, n, j = np.concatenate([a["nodes"], b["nodes"]]), np.concatenate([a["n"], b["n"]]), j + len(a["x"])
            degree = (np.bincount(i, n[j], len(ids)) + np.bincount(j, n[i], len(ids))).astype(np.int64)
        some = np.flatnonzero(degree)
        if not len(some):
            return None
        root = components_of_pairs(len(ids), i, j)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(degree[some])], ["id", "root", "degree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                here = (row["a"], row["b"])
                if unit != here:
                    unit, held = here, []
                row["x"] = unpacked(row.pop("vectors"), row["dim"])
                row["nodes"], row["n"] = (np.frombuffer(row.pop(c), np.int64) for c in ("ids", "copies"))
                own = row["a"] == row["b"]
                if row["side"] == 0:
                    held.append(row)
                if row["side"] == 1 or own:
                    for other in held:
                        same = other is row
                        if (same or not far(angle, other, row)) and (found := links(other, row, same)) is not None:
                            yield found

    return run


def embedding_components(rows: DataFrame, threshold: float = 0.98) -> DataFrame:
    """One row per row of ``rows(vec_id, embedding, label)``: vec_id, n_links, component_id, kept."""
    rows = rows.select(column_or_null(rows, "vec_id", "long").alias("vec_id"), column_or_null(rows, "embedding", "array<double>").alias("embedding"), column_or_null(rows, "label", "long").alias("label"))
    fine = F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & fine, F.lit(False))
    keys = ["k1", "k2"]
    keyed = rows.withColumns({"k1": F.xxhash64("label", "embedding"), "k2": F.xxhash64(F.lit(77), "label", F.size("embedding"), "embedding")})
    folded = keyed.filter(usable).groupBy(*keys).agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    # The numbers of the nodes become fixed as the table is written.
    folded = materialize(folded.withColumn("node", F.monotonically_increasing_id()), "embedding-folded")
    # A fixed direction: the first components' sum orders near vectors near each other.
    most = F.array_max(F.transform("embedding", F.abs))
    even = F.transform("embedding", lambda x: x / most)
    length = F.sqrt(F.aggregate(even, F.lit(0.0), lambda s, x: s + x * x))
    along = F.aggregate(F.transform(even, lambda x, i: x * F.when(i % 2 == 0, 1.0).otherwise(-1.0)), F.lit(0.0), lambda s, x: s + x) / length
    dealt = folded.select("label", F.size("embedding").alias("dim"), "node", "copies", "embedding", along.alias("along"))
    dealt = dealt.repartitionByRange("label", "dim", "along", "node").sortWithinPartitions("label", "dim", "along").drop("along")
    tiles = materialize(dealt.mapInArrow(_tiles(TILE, GROUP), TILES), "embedding-tiles")
    # Pairs of groups of one label, dealt over DEALS x DEALS cells: a group stands in one row and one column of them.
    groups = groups_of(tiles).withColumns({"own": F.pmod(F.xxhash64("grp"), F.lit(DEALS)).cast("int"), "other": F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1)))})
    side = F.when(F.col("own") <= F.col("other"), 0).otherwise(1)
    cells = groups.select("label", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "grp", "centre", "radius")
    cells = cells.repartition("label", "dim", "i", "j").sortWithinPartitions("label", "dim", "i", "j", "side")
    pairs = materialize(cells.mapInArrow(_group_pairs(float(np.arccos(threshold))), "label long, dim int, a long, b long"), "embedding-pairs")
    roles = pairs.select("a", "b", F.lit(0).alias("side"), F.col("a").alias("grp")).unionAll(pairs.filter("a <> b").select("a", "b", F.lit(1), "b"))
    work = roles.join(tiles.drop("tile"), "grp").select("a", "b", "side", "dim", "centre", "radius", "ids", "copies", "vectors")
    work = work.repartition("a", "b").sortWithinPartitions("a", "b", "side")
    links = materialize(work.mapInArrow(_multiply(threshold), "id long, root long, degree long"), "embedding-links")
    parts = connected_components(links.select(F.col("id").alias("a"), F.col("root").alias("b")), "embedding-parts")
    degrees = links.groupBy(F.col("id").alias("node")).agg(F.sum("degree").alias("degree"))
    nodes = folded.select(*keys, "node", "least", "copies").join(degrees, "node", "left").join(parts, "node", "left")
    n_links = F.coalesce("degree", F.lit(0)) + F.col("copies") - 1
    nodes = materialize(nodes.select(*keys, "least", F.col("copies").alias("rows"), F.coalesce("component", "node").alias("part"), n_links.alias("n_links")), "embedding-nodes")
    n_nodes, n_rows = nodes.agg(F.count(F.lit(1)), F.sum("rows")).first()
    names = nodes.groupBy("part").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("copies"))
    named = join_split(nodes, names, ["part"], n_nodes).select(*keys, F.col("rows").alias("copies"), "n_links", "component_id")
    tied = join_split(keyed.filter(usable).select("vec_id", *keys), materialize(named, "embedding-names"), keys, n_rows or 0)
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = tied.select("vec_id", "n_links", "component_id").unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
