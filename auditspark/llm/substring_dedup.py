"""Substring dedup: repeated word windows are removed, behind a count-min prefilter.

Texts are packed into chunks of bounded size, written once as a table that is bucketed by part (some chunks of one task), so
the passes below read it again without moving a text.

First pass: each chunk counts its windows in a sparse count-min sketch (ROWS rows of cells, counters that stop at two). A row
has at least CELLS cells a window of the whole corpus, however large it is; cells lie in shards by ranges of their numbers.
A chunk sends each shard the cells that it hits as a compact sorted list (some ten bits a window); the shard merges the lists
and answers each with one bit a cell: whether two or more hits reached it. Neither a shard nor an answer grows with the
corpus, and no task or driver ever holds the whole sketch. Counts are never underestimated, so no repeated window is lost,
and the share of single windows that pass stays the same at any size.

Second pass: a chunk's answers meet it again; only windows estimated repeated in all rows are grouped exactly, by 128-bit
hashes, and those whose words also start in a document with a smaller id are marked. Chunks combine before the shuffle, so a
window that a third of all documents share is one row a chunk. Marks go back to their parts by number.

Defined results: a null text has no words; a null doc_id is smaller than nothing and nothing is smaller than it; of rows
that repeat a doc_id none removes words of another; an empty table gives an empty result; other columns are ignored. Texts
are processed whole, in pieces of bounded size.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import column_or_null, materialize, mix64, shared_folder

WIDTH = 13
PIECE = 1 << 22
SPACE = re.compile(rb"[\x20\x09-\x0D]")
ROWS = 2
#: Cells a window and row, at least; and cells of a shard.
CELLS = 3
SHARD_BITS = 25
#: Bytes of text in a chunk, unless one text is longer, and chunks of a part.
CHUNK_BYTES = 12_000_000
PART_CHUNKS = 4


def pieces(data: bytes) -> Iterator[bytes]:
    """The text in parts of about PIECE bytes, cut at white space."""
    at = 0
    while len(data) - at > PIECE:
        m = SPACE.search(data, at + PIECE)
        if not m:
            break
        yield data[at : m.start()]
        at = m.end()
    yield data[at:] if at else data


def word_hashes(data: bytes) -> np.ndarray:
    parts = []
    for piece in pieces(data):
        words = piece.split()
        parts.append(np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def window_hashes(words: np.ndarray, width: int, salt: int) -> np.ndarray:
    """A hash of each run of ``width`` words, by their places."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = mix64(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out += words[i : i + n] * factors[i]
    return mix64(out)


def grouped(ids: list[int | None], texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a chunk: for each its document's index and first word, and all word hashes with the windows' places among
    them. Documents without an id have none."""
    hashes = [np.zeros(0, np.uint64) if i is None or not t else word_hashes(t) for i, t in zip(ids, texts)]
    lengths = np.array([len(h) for h in hashes], np.int64)
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    counts = np.maximum(lengths - width + 1, 0)
    doc = np.repeat(np.arange(len(ids)), counts)
    first = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return doc, first, words, (np.cumsum(lengths) - lengths)[doc] + first


def pack(numbers: np.ndarray, universe: int) -> bytes:
    """Sorted distinct numbers below ``universe`` in about 2 + log2(universe / n) bits each: low bits as they are, the rest in
    unary (Elias-Fano)."""
    n = len(numbers)
    low = max(0, (universe // max(n, 1)).bit_length() - 1)
    high = np.zeros(n + (universe >> low) + 1, np.uint8)
    high[(numbers >> low) + np.arange(n)] = 1
    bits = ((numbers[:, None] >> np.arange(low)) & 1).astype(np.uint8)
    return n.to_bytes(4, "little") + bytes([low]) + np.packbits(bits).tobytes() + np.packbits(high).tobytes()


def unpack(data: bytes) -> np.ndarray:
    n, low = int.from_bytes(data[:4], "little"), data[4]
    end = 5 + (n * low + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, end - 5, 5), count=n * low).reshape(n, low)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=end)))[:n] - np.arange(n)
    return (high << low) + bits @ (1 << np.arange(low, dtype=np.int64))


def press_chunk(ids: list[int | None], texts: list[bytes]) -> bytes:
    """A chunk's documents: how many, their ids (0 for none), which have one, lengths, texts."""
    known = np.array([i is not None for i in ids], np.uint8)
    columns = (np.array([i or 0 for i in ids], np.int64), known, np.array([len(t) for t in texts], np.int64))
    return len(ids).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join([*(c.tobytes() for c in columns), *texts]))


def read_chunk(data: bytes) -> tuple[list[int | None], list[bytes]]:
    n, rest = int.from_bytes(data[:8], "little"), zstandard.ZstdDecompressor().decompress(data[8:])
    ids, known, lengths = np.frombuffer(rest, np.int64, n), np.frombuffer(rest, np.uint8, n, 8 * n), np.frombuffer(rest, np.int64, n, 9 * n)
    ends = np.cumsum(lengths) + 17 * n
    return [i if k else None for i, k in zip(ids.tolist(), known.tolist())], [rest[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist())]


def chunk_table(rows: DataFrame, n_bytes: int) -> DataFrame:
    """``rows(doc_id, text)`` as written chunks ``(part, chunk, data)``, bucketed by part; a chunk is numbered within its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, size = TaskContext.get().partitionId() << 24, 0, 0
        ids, texts, held = [], [], 0

        def out():
            nonlocal part, chunk, size, ids, texts, held
            record = pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([chunk], pa.int32()), pa.array([press_chunk(ids, texts)], pa.binary())], ["part", "chunk", "data"])
            chunk, size = chunk + 1, size + held
            if size >= PART_CHUNKS * CHUNK_BYTES:
                part, chunk, size = part + 1, 0, 0
            ids, texts, held = [], [], 0
            return record

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                ids.append(doc)
                texts.append(text.as_py() or b"")
                held += len(texts[-1]) + 17
                if held >= CHUNK_BYTES:
                    yield out()
        if ids:
            yield out()

    spark = rows.sparkSession
    # Some buckets for each part, so few hold several of them; Spark allows no more than 100,000.
    buckets = min(100_000, max(4 * spark.sparkContext.defaultParallelism, n_bytes // CHUNK_BYTES))
    name = f"substring_chunks_{uuid.uuid4().hex}"
    chunks = rows.mapInArrow(run, "part long, chunk int, data binary")
    chunks.write.option("compression", "none").option("path", f"{shared_folder(spark)}/{name}").bucketBy(buckets, "part").format("parquet").saveAsTable(name)
    return spark.table(name)


def cells_of(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch, which has 2**bits of them."""
    return (mix64(hashes + np.uint64(row * 0x632BE5AB + row)) >> np.uint64(64 - bits)).astype(np.int64)


def shard_cuts(cells: np.ndarray, shard_bits: int) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of sorted cells."""
    shard = cells >> shard_bits
    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(cells)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield int(shard[a]), a, b


def send_sketches(chunks: DataFrame, width: int, bits: int, shard_bits: int) -> DataFrame:
    """Rows ``(line, shard, part, chunk, hit, twice)``: the cells of a row that a chunk hits, and which of them it hits twice."""
    schema = pa.schema([("line", pa.int32()), ("shard", pa.int64()), ("part", pa.int64()), ("chunk", pa.int32()), ("hit", pa.binary()), ("twice", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, chunk, data in zip(*(c.to_pylist() for c in batch.columns)):
                _, _, words, at = grouped(*read_chunk(data), width)
                hashes = window_hashes(words, width, 1)[at]
                for line in range(ROWS):
                    cells, counts = np.unique(cells_of(hashes, line, bits), return_counts=True)
                    out = [(line, shard, part, chunk, pack(cells[a:b] - (shard << shard_bits), 1 << shard_bits), pack(np.flatnonzero(counts[a:b] > 1), b - a)) for shard, a, b in shard_cuts(cells, shard_bits)]
                    for lo in range(0, len(out), 256):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[lo : lo + 256]), schema)], schema=schema)

    return chunks.select("part", "chunk", "data").mapInArrow(run, "line int, shard long, part long, chunk int, hit binary, twice binary")


def answer_sketches(sent: DataFrame, shard_bits: int) -> DataFrame:
    """Rows ``(part, answer)``: for each list of cells one bit a cell, whether two or more hits of all chunks reached it."""

    def merge(table: pa.Table) -> pa.Table:
        once, twice = np.zeros(1 << shard_bits, bool), np.zeros(1 << shard_bits, bool)
        lists = []
        for hit, two in zip(table.column("hit"), table.column("twice")):
            at = unpack(hit.as_py()).astype(np.uint32)
            twice[at[once[at]]] = True
            twice[at[unpack(two.as_py())]] = True
            once[at] = True
            lists.append(at)
        bits = [np.packbits(twice[at]).tobytes() for at in lists]
        return pa.table([table.column("line"), table.column("shard"), table.column("part"), table.column("chunk"), pa.array(bits, pa.binary())], ["line", "shard", "part", "chunk", "bits"])

    return sent.groupBy("line", "shard").applyInArrow(merge, "line int, shard long, part long, chunk int, bits binary")


def repeated(hashes: np.ndarray, answers: dict[tuple[int, int], bytes], bits: int, shard_bits: int) -> np.ndarray:
    """Which windows of a chunk the sketch estimates repeated."""
    keep = np.ones(len(hashes), bool)
    for line in range(ROWS):
        cells, inverse = np.unique(cells_of(hashes, line, bits), return_inverse=True)
        hot = np.zeros(len(cells), bool)
        for shard, a, b in shard_cuts(cells, shard_bits):
            hot[a:b] = np.unpackbits(np.frombuffer(answers[line, shard], np.uint8), count=b - a)
        keep &= hot[inverse]
    return keep


def pack_marks(part: np.ndarray, chunk: np.ndarray, doc: np.ndarray, first: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(part, its marks): sorted columns, which press well."""
    order = np.lexsort((first, doc, chunk, part))
    part, chunk, doc, first, length = (x[order] for x in (part, chunk, doc, first, length))
    pressed = zstandard.ZstdCompressor(level=1)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            columns = (np.diff(chunk[a:b], prepend=0), np.diff(doc[a:b], prepend=0), np.diff(first[a:b], prepend=0), length[a:b])
            yield int(part[a]), (b - a).to_bytes(8, "little") + pressed.compress(b"".join(c.astype(np.int32).tobytes() for c in columns))


def unpack_marks(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    parts = [np.zeros((4, 0), np.int64)]
    for blob in blobs:
        found = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:]), np.int32).reshape(4, -1).astype(np.int64)
        found[:3] = np.cumsum(found[:3], axis=1)
        parts.append(found)
    return tuple(np.concatenate(parts, axis=1))


def send_windows(chunks: DataFrame, answers: DataFrame, width: int, bits: int, shard_bits: int, shards: int) -> DataFrame:
    """Rows ``(shard, part, data)``: windows estimated repeated, for their shards; and, with their part, marks decided here."""
    schema = pa.schema([("shard", pa.int32()), ("part", pa.int64()), ("data", pa.binary())])

    def combine(part: int, chunk: int, ids: np.ndarray, doc, first, h1, h2) -> Iterator[tuple[int, int | None, bytes]]:
        """Decide what the chunk alone shows, and send the rest, the least document's windows, to their shards."""
        order = np.lexsort((first, doc, ids[doc], h2, h1))
        doc, first, h1, h2 = doc[order], first[order], h1[order], h2[order]
        new = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
        least = np.repeat(ids[doc[new]], np.diff(np.append(new, len(doc))))
        decided = ids[doc] > least
        # Marked already: by document, as runs.
        d, f = doc[decided], first[decided]
        if len(d):
            by = np.lexsort((f, d))
            d, f, n = runs_of(d[by], f[by])
            for p, blob in pack_marks(np.full(len(d), part), np.full(len(d), chunk), d, f, n):
                yield p % shards, p, blob
        # Equal windows of one document at consecutive places become one run.
        doc, first, h1, h2 = doc[~decided], first[~decided], h1[~decided], h2[~decided]
        start = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (doc[1:] != doc[:-1]) | (first[1:] != first[:-1] + 1)]))
        length = np.diff(np.append(start, len(doc)))
        doc, first, h1, h2 = doc[start], first[start], h1[start], h2[start]
        shard = ((h1 >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        # In document order within a shard, which packs well.
        order = np.lexsort((first, doc, shard))
        doc, first, h1, h2, length, shard = (x[order] for x in (doc, first, h1, h2, length, shard))
        pressed = zstandard.ZstdCompressor(level=1)
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(cuts, cuts[1:]):
            used, index = np.unique(doc[a:b], return_inverse=True)
            packed = (ids[used], used.astype(np.int32), np.diff(index, prepend=0).astype(np.int32), np.diff(first[a:b], prepend=0).astype(np.int32), length[a:b].astype(np.int32))
            head = np.array([b - a, len(used), part, chunk], np.int64)
            yield int(shard[a]), None, head.tobytes() + h1[a:b].tobytes() + h2[a:b].tobytes() + pressed.compress(b"".join(c.tobytes() for c in packed))

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[int, dict[tuple[int, int], bytes]] = {}
        for line, shard, chunk, hot in zip(*(right.column(c).to_pylist() for c in ("line", "shard", "chunk", "bits"))):
            found.setdefault(chunk, {})[line, shard] = hot
        out: list[tuple[int, int | None, bytes]] = []
        for part, chunk, data in zip(left.column("part").to_pylist(), left.column("chunk").to_pylist(), left.column("data")):
            ids, texts = read_chunk(data.as_py())
            doc, first, words, at = grouped(ids, texts, width)
            if not len(doc):
                continue
            h1 = window_hashes(words, width, 1)[at]
            keep = np.flatnonzero(repeated(h1, found[chunk], bits, shard_bits))
            if len(keep):
                h2 = window_hashes(words, width, 2)[at[keep]]
                out += combine(part, chunk, np.array([i or 0 for i in ids], np.int64), doc[keep], first[keep], h1[keep], h2)
        columns = zip(*out) if out else ((), (), ())
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    # Chunks are read by buckets of parts: only the answers are shuffled.
    return chunks.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(probe, "shard int, part long, data binary")


def group_windows(sent: DataFrame) -> DataFrame:
    """Rows ``(part, data)``: packed marks of each part's windows that start in a smaller document too."""

    def group(table: pa.Table) -> pa.Table:
        marked_parts, blobs, parts = [], [], []
        for part, cell in zip(table.column("part").to_pylist(), table.column("data")):
            data = cell.as_py()
            if part is not None:
                marked_parts.append(part)
                blobs.append(data)
                continue
            n, m, part, chunk = np.frombuffer(data, np.int64, 4).tolist()
            h1, h2 = np.frombuffer(data, np.uint64, n, 32), np.frombuffer(data, np.uint64, n, 32 + 8 * n)
            rest = zstandard.ZstdDecompressor().decompress(data[32 + 16 * n :])
            ids, used = np.frombuffer(rest, np.int64, m), np.frombuffer(rest, np.int32, m, 8 * m)
            index, first, length = (np.frombuffer(rest, np.int32, n, 12 * m + 4 * n * i) for i in range(3))
            index = np.cumsum(index)
            parts.append((ids[index], h1, h2, np.full(n, part), np.full(n, chunk, np.int32), used[index], np.cumsum(first, dtype=np.int32), length))
        if parts:
            ids, h1, h2, *place = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((ids, h2, h1))
            ids, h1, h2 = ids[order], h1[order], h2[order]
            new = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
            marked = order[ids > np.repeat(ids[new], np.diff(np.append(new, len(ids))))]
            for part, blob in pack_marks(*(c[marked] for c in place)):
                marked_parts.append(part)
                blobs.append(blob)
        return pa.table({"part": pa.array(marked_parts, pa.int64()), "data": pa.array(blobs, pa.binary())})

    return sent.groupBy("shard").applyInArrow(group, "part long, data binary")


def runs_of(doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (document, place) pairs as runs: document, first place, length."""
    start = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (first[1:] != first[:-1] + 1)]))
    return doc[start], first[start], np.diff(np.append(start, len(doc)))


def kept_text(data: bytes, runs: np.ndarray, width: int) -> tuple[int, int, bytes]:
    """Words in all, words removed, and the kept words joined by one space."""
    edge: dict[int, int] = {}
    words_seen, removed, kept = 0, 0, []
    order = np.argsort(runs[:, 0], kind="stable")
    first, stop = runs[order, 0].astype(np.int64), (runs[:, 0].astype(np.int64) + runs[:, 1] + width - 1)[order]
    for piece in pieces(data):
        words = piece.split()
        n = len(words)
        lo, hi = np.clip(first - words_seen, 0, n), np.clip(stop - words_seen, 0, n)
        change = np.bincount(lo, minlength=n + 1)[: n + 1] - np.bincount(hi, minlength=n + 1)[: n + 1]
        gone = np.cumsum(change)[:n] > 0
        removed += int(gone.sum())
        kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]) if gone.any() else b" ".join(words))
        words_seen += n
    return words_seen, removed, b" ".join(k for k in kept if k)


def sketch_of(chunks: DataFrame, n_bytes: int, width: int, cells: int = CELLS, shard_bits: int = SHARD_BITS) -> tuple[DataFrame, int, int]:
    """The answers to all chunks, the bits of a row's size and of a shard's. A word and its space take six bytes or so."""
    bits = max(16, (cells * max(1, n_bytes // 6)).bit_length())
    shard_bits = min(shard_bits, bits)
    return answer_sketches(send_sketches(chunks, width, bits, shard_bits), shard_bits), bits, shard_bits


def passed_share(docs: DataFrame, width: int = WIDTH, cells: int = CELLS, shard_bits: int = SHARD_BITS) -> DataFrame:
    """Rows ``(part, windows, passed)``: how many windows the prefilter passes to the second pass."""
    rows = docs.select(column_or_null(docs, "doc_id", "long").alias("doc_id"), column_or_null(docs, "text", "string").alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = chunk_table(rows, n_bytes)
    answers, bits, shard_bits = sketch_of(chunks, n_bytes, width, cells, shard_bits)

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        windows, passed, part = 0, 0, None
        for part, chunk, data in zip(left.column("part").to_pylist(), left.column("chunk").to_pylist(), left.column("data").to_pylist()):
            found = {(line, shard): hot for line, shard, c, hot in zip(*(right.column(c).to_pylist() for c in ("line", "shard", "chunk", "bits"))) if c == chunk}
            _, _, words, at = grouped(*read_chunk(data), width)
            windows += len(at)
            passed += int(repeated(window_hashes(words, width, 1)[at], found, bits, shard_bits).sum()) if len(at) else 0
        return pa.table({"part": [part], "windows": [windows], "passed": [passed]})

    return chunks.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(count, "part long, windows long, passed long")


def dedup_substrings(docs: DataFrame, width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_words, n_removed, kept_sha256, and with_text the kept text."""
    spark = docs.sparkSession
    rows = docs.select(column_or_null(docs, "doc_id", "long").alias("doc_id"), column_or_null(docs, "text", "string").alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = chunk_table(rows, n_bytes)
    answers, bits, shard_bits = sketch_of(chunks, n_bytes, width)
    shards = max(2 * spark.sparkContext.defaultParallelism, n_bytes // 24_000_000)
    marks = materialize(group_windows(send_windows(chunks, answers, width, bits, shard_bits, shards)), "substring-marks")
    none = np.zeros((0, 2), np.int64)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        in_chunk, doc, first, length = unpack_marks(right.column("data").to_pylist())
        order = np.lexsort((first, doc, in_chunk))
        in_chunk, doc, runs = in_chunk[order], doc[order], np.stack([first[order], length[order]], axis=1)
        tables = []
        for chunk, data in zip(left.column("chunk").to_pylist(), left.column("data")):
            ids, texts = read_chunk(data.as_py())
            a, b = np.searchsorted(in_chunk, [chunk, chunk + 1])
            bounds = a + np.searchsorted(doc[a:b], np.arange(len(ids) + 1))
            found = []
            for i, text in enumerate(texts):
                lo, hi = int(bounds[i]), int(bounds[i + 1])
                n, removed, kept = kept_text(text, runs[lo:hi] if hi > lo else none, width)
                found.append((n, removed, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            n, removed, sha, kept = zip(*found)
            tables.append(pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.binary()).cast(pa.string())}))
        return pa.concat_tables(tables)

    out = chunks.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out if with_text else out.drop("kept")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
