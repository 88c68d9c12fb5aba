"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are 64-bit. Two that differ in at most k bits agree on at least one of k + 1 blocks, so an index is kept
for each block value: its fingerprints are sorted by Gray rank by a range shuffle, which also splits a hot block value
over many tasks, and cut into leaves of consecutive fingerprints. A leaf factors out what its members share as a mask and
a pattern; leaves are grouped below upper nodes in the same way. A search accumulates the differences between shared
patterns from the upper nodes down, and prunes whole groups once they exceed k; only members of the groups left are
compared. Each comparison of two tiles returns a spanning forest of its links, never all pairs.

Defined results: a null or empty text has fingerprint 0 and links like any other; a null doc_id never names a component
(null if a component has no other); repeated rows each get a row; an empty table gives an empty result. Long texts are
hashed whole, in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import column_or_null, components_of_pairs, connected_components, fresh, join_split, materialize

SEED = 42
PIECE = 1 << 15
TILE = 512
LEAF = 16
#: Tiles on each side of a cell, where one block value has many tiles.
CELL = 64


def shingle_hashes(text: bytes | None, words: int = 3) -> np.ndarray:
    """Hashes of the runs of so many words, in order; of all words if there are fewer."""
    found = (text or b"").lower().split()  # bytes.lower() changes A-Z only
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends[min(words, len(found)) - 1 :].tolist()
    return np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends)], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes."""
    counts, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, PIECE):
        counts += np.unpackbits(hashes[at : at + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """A bit is 1 if set in over half of the shingles' hashes."""
    return fingerprint_of(shingle_hashes(text, words))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x) for x in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each pattern in the reflected Gray code."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def shared(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the bits that all members of each row agree on, and those bits."""
    both, either = np.bitwise_and.reduce(groups, axis=1), np.bitwise_or.reduce(groups, axis=1)
    mask = ~(both ^ either)
    return mask, both & mask


def nodes(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves of consecutive fingerprints (the last one padded with its last member), their masks and patterns."""
    groups = np.concatenate([fps, np.repeat(fps[-1:], -len(fps) % LEAF)]).reshape(-1, LEAF)
    return groups, *shared(groups)


def search(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into a, into b) of fingerprints that differ in at most k bits, by pruned descent of both trees."""
    (ga, ma, pa_), (gb, mb, pb) = nodes(a), nodes(b)
    # Upper nodes share fewer bits than their leaves: what they differ in already, and what the leaves add to it.
    upper_a, upper_b = shared(ma_groups(ga)), shared(ma_groups(gb))
    above = np.bitwise_count((upper_a[0][:, None] & upper_b[0]) & (upper_a[1][:, None] ^ upper_b[1]))
    ua, ub = np.nonzero(above <= k)
    la, lb = [], []
    for i, j in zip(ua.tolist(), ub.tolist()):
        x, y = slice(i * LEAF, min((i + 1) * LEAF, len(ga))), slice(j * LEAF, min((j + 1) * LEAF, len(gb)))
        fresh = ~(upper_a[0][i] & upper_b[0][j])
        more = np.bitwise_count(ma[x][:, None] & mb[y] & fresh & (pa_[x][:, None] ^ pb[y]))
        p, q = np.nonzero(above[i, j].astype(np.int64) + more <= k)
        la.append(p + x.start)
        lb.append(q + y.start)
    if not any(map(len, la)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    la, lb = np.concatenate(la), np.concatenate(lb)
    left, right = [], []
    for at in range(0, len(la), 4096):
        p, q = la[at : at + 4096], lb[at : at + 4096]
        n, i, j = np.nonzero(np.bitwise_count(ga[p][:, :, None] ^ gb[q][:, None, :]) <= k)
        left.append(p[n] * LEAF + i)
        right.append(q[n] * LEAF + j)
    left, right = np.concatenate(left), np.concatenate(right)
    real = (left < len(a)) & (right < len(b))
    return left[real], right[real]


def ma_groups(leaves: np.ndarray) -> np.ndarray:
    """Members of each upper node: LEAF leaves, the last node padded."""
    padded = np.concatenate([leaves, np.repeat(leaves[-1:], -len(leaves) % LEAF, axis=0)])
    return padded.reshape(-1, LEAF * LEAF)


def _tiles(size: int):
    """Cut a partition, sorted by block and Gray rank, into tiles: at most ``size`` consecutive fingerprints of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def cut(block, fps, final):
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(block))
            out, done = [], 0
            for s, e in zip(starts.tolist(), ends.tolist()):
                if e == len(block) and not final:
                    stop = s + (e - s) // size * size
                    out += [(s + i, s + i + size) for i in range(0, stop - s, size)]
                    done = stop
                else:
                    out += [(i, min(i + size, e)) for i in range(s, e, size)]
                    done = e
            return out, done

        def record(block, fps, spans):
            mask, pattern = zip(*((int(m[0]), int(p[0])) for m, p in (shared(fps[s:e].view(np.uint64)[None, :]) for s, e in spans)))
            return pa.RecordBatch.from_arrays([
                pa.array([int(block[s]) for s, _ in spans], pa.int64()), pa.array([int(fps[s]) for s, _ in spans], pa.int64()),
                pa.array(np.array(mask, np.uint64).view(np.int64)), pa.array(np.array(pattern, np.uint64).view(np.int64)),
                pa.array([fps[s:e].tobytes() for s, e in spans], pa.binary()),
            ], ["block", "tile", "mask", "pattern", "fps"])

        for batch in batches:
            block = np.concatenate([block, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy()])
            spans, done = cut(block, fps, False)
            for i in range(0, len(spans), 4096):
                yield record(block, fps, spans[i : i + 4096])
            block, fps = block[done:], fps[done:]
        spans, _ = cut(block, fps, True)
        for i in range(0, len(spans), 4096):
            yield record(block, fps, spans[i : i + 4096])

    return run


def small_pairs(parts: list[bytes], k: int) -> np.ndarray:
    """Links within tiles of one leaf each, which have no upper node to prune by: all such tiles at once, by distance in
    Gray order."""
    fps = np.frombuffer(b"".join(parts), np.uint64)
    tile = np.repeat(np.arange(len(parts)), [len(p) // 8 for p in parts])
    left, right = [], []
    for step in range(1, min(LEAF, len(fps))):
        at = np.flatnonzero((tile[step:] == tile[:-step]) & (np.bitwise_count(fps[step:] ^ fps[:-step]) <= k))
        left.append(fps[at])
        right.append(fps[at + step])
    return np.stack([np.concatenate(left), np.concatenate(right)]) if left else np.zeros((2, 0), np.uint64)


def forest(a: np.ndarray, b: np.ndarray | None, k: int) -> np.ndarray:
    """Spanning links of those within a tile (b is None) or between two."""
    left, right = search(a, a if b is None else b, k)
    if b is None:
        keep = left < right
        left, right = left[keep], right[keep]
    else:
        right = right + len(a)
    both = a if b is None else np.concatenate([a, b])
    label = components_of_pairs(len(both), left, right)
    tied = np.flatnonzero(label != np.arange(len(both)))
    return np.stack([both[label[tied]], both[tied]])


def _edges(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if found:
        edges = np.unique(np.concatenate(found, axis=1), axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], ["a", "b"])


def _within(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles = batch.column(0).to_pylist()
            found = [small_pairs([t for t in tiles if len(t) <= 8 * LEAF], k)]
            found += [forest(np.frombuffer(t, np.uint64), None, k) for t in tiles if len(t) > 8 * LEAF]
            yield from _edges(found)

    return run


def _across(k: int):
    """Cells of the grid, sorted: a cell's rows of side 0, which are held, come before those of side 1. In a cell on the
    diagonal all are of side 0, and each meets those before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, masks, patterns = None, [], [], []
        for batch in batches:
            found = []
            for block, i, j, side, mask, pattern, fps in zip(*(c.to_pylist() for c in batch.columns)):
                if cell != (block, i, j):
                    cell, held, masks, patterns = (block, i, j), [], [], []
                mine = np.frombuffer(fps, np.uint64)
                mask, pattern = np.array([mask, pattern], np.int64).view(np.uint64)
                if side == 1 or i == j:
                    apart = np.bitwise_count(np.array(masks, np.uint64) & mask & (np.array(patterns, np.uint64) ^ pattern))
                    found += [forest(held[n], mine, k) for n in np.flatnonzero(apart <= k).tolist()]
                if side == 0:
                    held.append(mine)
                    masks.append(mask)
                    patterns.append(pattern)
            yield from _edges(found)

    return run


def near_links(fps: DataFrame, k: int = 3, blocks: int | None = None) -> DataFrame:
    """Rows ``(a, b)``: spanning links of the distinct fingerprints in ``fps(fp)`` that differ in at most ``k`` bits.

    blocks: how many blocks the 64 bits are cut into; an index is kept for each choice of ``blocks - k`` of them, over
    all of which any linked pair agrees at least once. By default k + 1, and k + 2 beyond 2**27 fingerprints.
    """
    from itertools import combinations

    n_fps = fps.count()
    if blocks is None:
        blocks = k + 1 if n_fps < 1 << 27 else k + 2
    edges_of = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - k)):
        mask = sum(((1 << edges_of[i + 1]) - (1 << edges_of[i])) for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(signed))))
    rank = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    # An equal hash of two block values only adds comparisons.
    dealt = fps.select(F.explode(F.array(*keys)).alias("block"), "fp", rank.alias("rank"))
    dealt = dealt.repartitionByRange("block", "rank").sortWithinPartitions("block", "rank").select("block", "fp")
    tiles = materialize(dealt.mapInArrow(_tiles(TILE), "block long, tile long, mask long, pattern long, fps binary"), "simhash-tiles")
    links = tiles.filter(F.length("fps") > 8).select("fps").mapInArrow(_within(k), "a long, b long")
    # Block values of several tiles: their tiles are dealt over a grid, whose cells hold about CELL tiles a side. A tile is
    # sent to one row and one column of cells, and whole groups go where their shared patterns differ too much already.
    several = tiles.groupBy("block").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    size = several.agg(F.sum("copies")).first()[0]
    if not size:
        return links
    many = join_split(tiles, several, ["block"], size).withColumn("k", F.ceil(F.col("copies") / CELL).cast("int"))
    own = F.pmod(F.xxhash64("tile"), F.col("k")).cast("int")
    cells = many.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    ahead = F.col("own") <= F.col("other")
    cells = cells.select("block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(ahead, 0).otherwise(1).alias("side"), "mask", "pattern", "fps")
    cells = cells.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "side")
    return links.unionAll(cells.mapInArrow(_across(k), "a long, b long"))


def simhash_components(docs: DataFrame, k: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed), component_id, the least doc_id reachable by links."""
    rows = docs.select(column_or_null(docs, "doc_id", "long").alias("doc_id"), F.coalesce(column_or_null(docs, "text", "string"), F.lit("")).alias("text"))
    prints = materialize(rows.mapInArrow(_fingerprints, "doc_id long, fp long"), "simhash-prints")
    groups = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "simhash-groups")
    parts = connected_components(near_links(groups.select("fp"), k), "simhash-parts")
    labelled = groups.join(parts, groups.fp == parts.node, "left").select("fp", "least", "rows", F.coalesce("component", "fp").alias("component"))
    labelled = materialize(labelled, "simhash-labelled")
    # Fingerprints of large components, then rows of hot fingerprints, are joined by a broadcast of bounded size.
    n_fps, n_rows = labelled.agg(F.count(F.lit(1)), F.sum("rows")).first()
    names = labelled.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("copies"))
    of_print = join_split(labelled, names, ["component"], n_fps).select("fp", "component_id", F.col("rows").alias("copies"))
    return join_split(prints, materialize(of_print, "simhash-names"), ["fp"], n_rows or 0).select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, k: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id (a null one last)."""
    names = docs.columns
    fp_, row_ = fresh(docs, "_fp", "_row")
    at, schema = names.index("text"), docs.withColumn(fp_, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x) for x in batch.column(at).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*names, fp_])

    # The numbers become fixed as the table is written.
    rows = materialize(docs.mapInArrow(run, schema).withColumn(row_, F.monotonically_increasing_id()), "simhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", F.col(row_).alias("_row")))
    groups = materialize(rows.groupBy(F.col(fp_).alias("fp")).agg(first.alias("best")), "simhash-groups")
    parts = connected_components(near_links(groups.select("fp"), k), "simhash-parts")
    labelled = groups.join(parts, groups.fp == parts.node, "left").select("best", F.coalesce("component", "fp").alias("component"))
    kept = labelled.groupBy("component").agg(F.min("best").alias("best")).select(F.col("best._row").alias(row_))
    return rows.join(kept, row_, "left_semi").select(*[f"`{c}`" for c in names])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
