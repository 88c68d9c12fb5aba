"""Exact search of the k greatest inner products, by KD-trees of shards.

Vectors of whole numbers are dealt into cells by the median splits of a bounded sample, so that a shard (at most SHARD
consecutive vectors of a cell) lies close together; the sample decides only where a vector is kept, never whether it is
found. A shard is a KD-tree: halves at the median of the widest component, down to leaves, with tight bounding boxes at each
node. The order of its vectors is the tree, so a shard is one row of packed numbers.

Queries travel in blocks. A unit of work is one block and one lane of shards; its task holds the block and streams the
shards past it, those of longest vectors first. In a shard a query descends from the root through nodes whose box may hold a
product as great as its k-th so far, then visits leaves in falling order of their bound and stops at the first that cannot
reach it. The k-th product goes on from shard to shard. Before that, every query meets the few longest vectors of each
shard, so all lanes begin with a k-th product that many vectors fall short of.

Bounds and products are exact: in double precision while no sum can reach 2**53, else in Python's numbers. A tie with the
k-th is kept, since a smaller vec_id wins.

Defined results: a vector that is null or holds a null or non-finite component takes no part; vectors of different lengths
never meet, an empty one has product 0 with each other empty one. The query's own row is left out by row, not by id: rows
that repeat a vec_id are candidates of each other, and queries of their own. A null vec_id is no query, and comes last among
ties; rows that tie in vec_id too come in any fixed order. A product beyond a long counts as the greatest (or least) long, and ties
with others that do.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column_or_null, forget, materialize
from .integer_vectors import EXACT, largest, pack_ints, rows_of, unpack_ints, usable, whole

SHARD = 8192
LEAF = 32
QUERIES = 1024
#: Shards of a lane, and vectors of a shard that all queries meet first.
LANE = 16
LONGEST = 8
#: Vectors that the dealing splits are fitted on, at most, and of a cell of the sample, at least.
SAMPLE = 4096
SAMPLE_CELL = 8
#: Components of a shard, a block or the sample, at most.
COMPONENTS = 1 << 22
LONG = (1 << 63) - 1


def cuts(n: int) -> np.ndarray:
    """Where the leaves of a tree of n vectors begin, and n: halves of halves, 2**levels of them."""
    edges = np.array([0, n])
    while n > LEAF:
        mids = (edges[:-1] + edges[1:]) // 2
        edges = np.sort(np.concatenate([edges, mids]))
        n = (n + 1) // 2
    return edges


def tree_order(x: np.ndarray) -> np.ndarray:
    """The vectors' order in the tree."""
    order = np.arange(len(x))
    edges = [0, len(x)]
    target = len(cuts(len(x))) - 1
    while len(edges) - 1 < target:
        after = [0]
        for a, b in zip(edges, edges[1:]):
            mid, part = (a + b) // 2, x[order[a:b]]
            widest = int((part.max(axis=0) - part.min(axis=0)).argmax()) if x.shape[1] else 0
            if x.shape[1]:
                order[a:b] = order[a:b][np.argpartition(part[:, widest], mid - a)]
            after += [mid, b]
        edges = after
    return order


def boxes(x: np.ndarray, edges: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Least and greatest components of each node, from the root's level to the leaves'."""
    levels = [(np.minimum.reduceat(x, edges[:-1], axis=0), np.maximum.reduceat(x, edges[:-1], axis=0))]
    while len(levels[0][0]) > 1:
        lo, hi = levels[0]
        levels.insert(0, (np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2])))
    return levels


class Best:
    """The k best candidates of each query of a block so far, and the product that a new one must reach."""

    def __init__(self, rows: np.ndarray, floor: np.ndarray, k: int):
        self.rows, self.floor, self.k = rows, floor, k
        self.query, self.score, self.vec, self.none, self.row = (np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.uint8, np.int64))

    def add(self, query: np.ndarray, score: np.ndarray, vec: np.ndarray, none: np.ndarray, row: np.ndarray) -> None:
        keep = (score >= self.floor[query]) & (row != self.rows[query])
        if not keep.any():
            return
        new = (query, score, vec, none, row)
        columns = [np.concatenate([old, c[keep]]) for old, c in zip((self.query, self.score, self.vec, self.none, self.row), new)]
        query, score, vec, none, row = columns
        # Python's numbers sort by their places among the distinct ones.
        falling = -score if score.dtype != object else np.unique(-score, return_inverse=True)[1]
        order = np.lexsort((row, vec, none, falling, query))
        query = query[order]
        start = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        place = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
        order = order[place < self.k]
        self.query, self.score, self.vec, self.none, self.row = (c[order] for c in columns)
        last = place[place < self.k] == self.k - 1
        full = self.query[last]
        self.floor[full] = np.maximum(self.floor[full], self.score[last])


def held(x: np.ndarray) -> np.ndarray:
    """Products as a long holds them: those beyond it count as its ends."""
    return np.maximum(np.minimum(x, LONG), -LONG - 1) if x.dtype == object else x


def visit(q: np.ndarray, x: np.ndarray, vec: np.ndarray, none: np.ndarray, row: np.ndarray, best: Best) -> None:
    """Search one shard, its vectors in tree order, for all queries of a block."""
    edges = cuts(len(x))
    levels = boxes(x, edges)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    live, mask = np.arange(len(q)), np.ones((len(q), 1), bool)
    for n, (lo, hi) in enumerate(levels):
        mask = np.repeat(mask, 2, axis=1) if n else mask
        some = mask.any(axis=1)
        live, mask = live[some], mask[some]
        if not len(live):
            return
        bound = held(up[live] @ hi.T + down[live] @ lo.T)
        mask &= bound >= best.floor[live][:, None]
    # Pruned leaves come last and are never visited.
    key = np.where(mask, -bound, np.inf if bound.dtype != object else float("inf"))
    order = np.argsort(key, axis=1, kind="stable")
    at, step, leaves = 0, 1, len(edges) - 1
    while len(live) and at < leaves:
        turn = np.arange(at, min(at + step, leaves))
        chosen = order[:, turn]
        inside = np.arange(len(live))[:, None]
        go = mask[inside, chosen] & (bound[inside, chosen] >= best.floor[live][:, None])
        i, j = np.nonzero(go)
        leaf = chosen[i, j]
        by = np.argsort(leaf, kind="stable")
        i, leaf = i[by], leaf[by]
        start = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]])) if len(leaf) else np.zeros(0, np.int64)
        found = []
        for s, e in zip(start.tolist(), [*start[1:].tolist(), len(leaf)]):
            a, b = int(edges[leaf[s]]), int(edges[leaf[s] + 1])
            asked = live[i[s:e]]
            score = held(q[asked] @ x[a:b].T)
            m, c = np.nonzero(score >= best.floor[asked][:, None])
            found.append((asked[m], score[m, c], c + a))
        if found:
            who, score, where = (np.concatenate(p) for p in zip(*found))
            best.add(who, score, vec[where], none[where], row[where])
        at, step = at + step, step * 2
        if at < leaves:
            # Leaves fall in their bounds, so the next one tells whether any is left.
            ahead = order[:, at]
            more = mask[np.arange(len(live)), ahead] & (bound[np.arange(len(live)), ahead] >= best.floor[live])
            live, mask, bound, order = live[more], mask[more], bound[more], order[more]


def _pack(scale: float, splits: list[tuple[int, int]]):
    """Rows as (dim, cell, vec_id, data): the cell is the path through the sample's splits, an implicit tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, lengths = rows_of(batch.column(1))
            x, ends = whole(values, scale), np.cumsum(lengths)
            starts, data = ends - lengths, [pack_ints(x[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
            node = np.zeros(len(lengths), np.int64)
            for _ in range((len(splits) + 1).bit_length() - 1):
                axis, value = (np.array(c, np.int64)[node] for c in zip(*splits))
                has = axis < lengths
                own = np.zeros(len(node), np.int64)
                own[has] = x[starts[has] + axis[has]]
                node = 2 * node + 1 + (own > value)
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int32()), pa.array(node), batch.column(0), pa.array(data, pa.binary())], ["dim", "cell", "vec_id", "data"])

    return run


def fit_splits(sample: np.ndarray, levels: int) -> list[tuple[int, int]]:
    """Axis and median of each inner node of a tree of so many levels, in order of levels."""
    groups, splits = [sample], []
    for _ in range(levels):
        halves = []
        for g in groups:
            axis = int((g.max(axis=0) - g.min(axis=0)).argmax()) if len(g) else 0
            value = int(np.sort(g[:, axis])[(len(g) - 1) // 2]) if len(g) else 0
            splits.append((axis, value))
            halves += [g[g[:, axis] <= value], g[g[:, axis] > value]]
        groups = halves
    return splits


SHARDS = "dim int, lane int, length double, n int, data binary, vec binary, none binary, row binary, kind string"


def _shards(size: int, longest: int, lane: int):
    """Sorted rows as shards, and of each shard its longest vectors as a small one."""
    names = [c.split()[0] for c in SHARDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def record() -> pa.RecordBatch:
            dim = key[0]
            x = np.stack([unpack_ints(d) for _, _, d in rows]) if dim else np.zeros((len(rows), 0), np.int64)
            row = np.array([r for r, _, _ in rows], np.int64)
            vec, none = np.array([v or 0 for _, v, _ in rows], np.int64), np.array([v is None for _, v, _ in rows], np.uint8)
            order = tree_order(x)
            x, row, vec, none = x[order], row[order], vec[order], none[order]
            length = (x.astype(np.float64) ** 2).sum(axis=1)
            # The longest vectors form a tree of their own.
            few = np.sort(np.argsort(-length, kind="stable")[:longest])
            few = few[tree_order(x[few])]
            out = []
            for kind, at in (("all", np.arange(len(x))), ("longest", few)):
                out.append((dim, lane_of(row[0]), float(length.max()), len(at), pack_ints(x[at]), vec[at].tobytes(), none[at].tobytes(), row[at].tobytes(), kind))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.float64(), pa.int32(), *[pa.binary()] * 4, pa.string()))], names)

        def lane_of(first: int) -> int:
            return int((int(first) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 33) % lane

        for batch in batches:
            for dim, cell, row, vec, data in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and (key != (dim, cell) or len(rows) == size):
                    yield record()
                    rows = []
                key = (dim, cell)
                rows.append((row, vec, data))
        if rows:
            yield record()

    return run


BLOCKS = "dim int, block int, n int, data binary, vec binary, row binary"


def _query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    names, held = [c.split()[0] for c in BLOCKS.split(", ")], {}

    def record(dim: int, rows: list) -> pa.RecordBatch:
        x = np.concatenate([unpack_ints(d) for _, _, d in rows])
        out = (dim, TaskContext.get().partitionId(), len(rows), pack_ints(x), np.array([v for _, v, _ in rows], np.int64).tobytes(), np.array([r for r, _, _ in rows], np.int64).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, (*[pa.int32()] * 3, *[pa.binary()] * 3))], names)

    for batch in batches:
        for dim, row, vec, data in zip(*(c.to_pylist() for c in batch.columns)):
            held.setdefault(dim, []).append((row, vec, data))
    for dim, rows in held.items():
        yield record(dim, rows)


def _search(k: int, only_scores: bool):
    """Units, sorted: the block of queries comes before the shards of the lane."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, q, best, vec_of = None, None, None, None

        def out() -> Iterator[pa.RecordBatch]:
            if best is None or not len(best.query):
                return
            score = np.array([int(s) for s in best.score.tolist()], np.int64)
            if only_scores:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), unit[1]), pa.int32()), pa.array(np.full(len(score), unit[0]), pa.int32()), pa.array(best.query), pa.array(score)], ["block", "dim", "place", "score"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(best.rows[best.query]), pa.array(vec_of[best.query]), pa.array(best.vec, mask=best.none == 1), pa.array(best.row), pa.array(score)], ["query", "query_id", "vec_id", "row", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if unit != (r["dim"], r["block"], r["lane"]):
                    yield from out()
                    unit, best = (r["dim"], r["block"], r["lane"]), None
                numbers = unpack_ints(r["data"]).reshape(r["n"], r["dim"])
                if r["side"] == 0:
                    q, vec_of = numbers, np.frombuffer(r["vec"], np.int64)
                    floor = np.full(len(q), -np.inf)
                    if r["floor"]:
                        where = [p["place"] for p in r["floor"]]
                        # A little less, so that rounding to double loses nothing.
                        floor[where] = np.nextafter(np.array([p["score"] for p in r["floor"]], np.float64), -np.inf)
                    best = Best(np.frombuffer(r["row"], np.int64), floor, k)
                elif best is not None:
                    kind = np.float64 if r["dim"] * largest(q) * max(largest(numbers), 1) < EXACT else object
                    if kind is object and best.floor.dtype != object:
                        best.floor = best.floor.astype(object)
                    visit(q.astype(kind), numbers.astype(kind), np.frombuffer(r["vec"], np.int64), np.frombuffer(r["none"], np.uint8), np.frombuffer(r["row"], np.int64), best)
        yield from out()

    return run


def units(blocks: DataFrame, shards: DataFrame, n_blocks: int, lanes: int) -> DataFrame:
    """Each block of queries with each lane of shards, sorted within the unit's task."""
    queries = blocks.select("dim", "block", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(0).alias("side"), F.lit(0.0).alias("order"), "n", "data", "vec", F.lit(None).cast("binary").alias("none"), "row", "floor")
    against = shards.select("dim", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "lane", F.lit(1).alias("side"), (-F.col("length")).alias("order"), "n", "data", "vec", "none", "row", F.lit(None).cast("array<struct<place:long,score:long>>").alias("floor"))
    both = queries.unionByName(against)
    return both.repartition("dim", "block", "lane").sortWithinPartitions("dim", "block", "lane", "side", "order")


def exact_top_k(rows: DataFrame, every: int = 100, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """Rows ``(query_id, rank, vec_id, score)``: the k greatest inner products of each row whose vec_id ``every`` divides with
    all other rows of ``rows(vec_id, embedding)``."""
    spark = rows.sparkSession
    rows = rows.select(column_or_null(rows, "vec_id", "long").alias("vec_id"), column_or_null(rows, "embedding", "array<double>").alias("embedding")).filter(usable("embedding"))
    total, n_queries, dim = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0), F.max(F.size("embedding"))).first()
    if not total or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # The dealing splits are fitted on vectors of the greatest length; others lie in cells by the components that they have.
    sample = rows.filter(F.size("embedding") == dim).orderBy(F.xxhash64("embedding", "vec_id"), "vec_id").limit(max(SAMPLE_CELL, min(SAMPLE, COMPONENTS // max(1, dim)))).collect()
    shard, block = (max(1, min(n, COMPONENTS // max(1, dim))) for n in (SHARD, QUERIES))
    levels = min(max(0, (total // shard).bit_length() - 1), max(0, (len(sample) // SAMPLE_CELL).bit_length() - 1)) if dim else 0
    splits = fit_splits(np.stack([whole(np.array(r.embedding), scale) for r in sample]), levels) if levels else []
    packed = rows.mapInArrow(_pack(scale, splits), "dim int, cell long, vec_id long, data binary")
    # The numbers of the rows become fixed as the table is written.
    packed = materialize(packed.withColumn("row", F.monotonically_increasing_id()), "search-rows")
    lanes = max(1, -(-total // (shard * LANE)), min(spark.sparkContext.defaultParallelism, -(-total // shard)))
    dealt = packed.select("dim", "cell", "row", "vec_id", "data").repartitionByRange("dim", "cell", "row").sortWithinPartitions("dim", "cell", "row")
    shards = materialize(dealt.mapInArrow(_shards(shard, LONGEST, lanes), SHARDS), "search-shards")
    n_blocks = -(-n_queries // block)
    asked = packed.filter(F.col("vec_id") % every == 0).select("dim", "row", "vec_id", "data").repartition(n_blocks)
    blocks = materialize(asked.mapInArrow(_query_blocks, BLOCKS), "search-queries")
    forget(packed)
    no_floor = blocks.withColumn("floor", F.lit(None).cast("array<struct<place:long,score:long>>"))
    few = -(-lanes // 64)
    firsts = shards.filter("kind = 'longest'").withColumn("lane", F.col("lane") % few)
    seeds = units(no_floor, firsts, n_blocks, few).mapInArrow(_search(k, True), "block int, dim int, place long, score long")
    ranked = seeds.withColumn("n", F.row_number().over(Window.partitionBy("dim", "block", "place").orderBy(F.desc("score")))).filter(F.col("n") == k)
    floors = materialize(ranked.groupBy("dim", "block").agg(F.collect_list(F.struct("place", "score")).alias("floor")), "search-floors")
    work = units(blocks.join(floors, ["dim", "block"], "left"), shards.filter("kind = 'all'"), n_blocks, lanes)
    found = materialize(work.mapInArrow(_search(k, False), "query long, query_id long, vec_id long, row long, score long"), "search-found")
    forget(shards, blocks, floors)
    over = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
