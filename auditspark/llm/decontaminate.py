"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A random walk over a word sequence (Chakraborty, Goldenberg, Koucky) writes out words while advancing by coin flips that
depend on step and word; two sequences at small edit distance then differ in few places, so edit distance becomes Hamming
distance. Windows as long as an item are embedded by several walks; tables that each sample a few places of an embedding
make windows and items collide, with as many tables as the target recall needs; what collides is verified exactly as an
approximate occurrence of the item in the document.

Not every window is embedded: an item of n words with at most t word edits keeps a run of at least (n - t) / (t + 1)
words untouched, and all but k t of its n - k + 1 runs of k words. So only windows aligned to a run of an item of that
length, and with as many such runs in reach, can match; this drops no match.

Defined results: null or empty texts and items match nothing; repeated rows each are searched; an empty table gives an
empty result; other columns are passed through. Words are runs of letters and digits, lower-cased; an item without any is
ignored. Of occurrences of an item in a text the one with fewest edits counts, then the first to begin. Items that repeat
an id are items of their own. Texts are searched whole, in slices of bounded size. Items reach the tasks in blocks of
bounded size, each block against all documents.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_or_null, mix64

TOKEN = re.compile(r"[^\W_]+")
RUN = 3
WALKS = 6
SAMPLED = 2
#: Share of embedding places that a pair at the greatest accepted distance is expected to agree on.
AGREE = 0.3
BLOCK_ITEMS = 20_000
BLOCK_WORDS = 2_000_000


def edits_allowed(n: int, share: float) -> int:
    return int(n * share + 1e-9)


def run_length(n: int, edits: int) -> int:
    """Words of an item of n words that some run keeps whatever the edits, at most RUN."""
    return max(1, min(RUN, n, -(-(n - edits) // (edits + 1))))


def tables_for(recall: float, sampled: int = SAMPLED, agree: float = AGREE) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - agree**sampled))


def embed(words: np.ndarray, starts: np.ndarray, n: int, walk: int, steps: np.ndarray) -> np.ndarray:
    """Words at the given steps of the walk over each window of n words; -2 past a window's end. words: ids, -1 unknown."""
    at = np.zeros(len(starts), np.int64)
    out = np.empty((len(starts), len(steps)), np.int64)
    wanted = {int(s): i for i, s in enumerate(steps)}
    for step in range(int(steps.max()) + 1):
        seen = np.where(at < n, words[np.minimum(starts + at, len(words) - 1)], -2)
        if step in wanted:
            out[:, wanted[step]] = seen
        coin = mix64((seen + 3).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step * 1_000_003 + walk * 7_919))
        at += (coin >> np.uint64(63)).astype(np.int64)
    return out


def sampled_keys(words: np.ndarray, starts: np.ndarray, n: int, tables: int, seed: int = 11) -> np.ndarray:
    """One key for each window and table; 0 where a sampled place is unknown or past the end, which matches nothing."""
    keys = np.zeros((len(starts), tables), np.uint64)
    for walk in range(WALKS):
        own = range(walk, tables, WALKS)
        if not len(own):
            continue
        # About two steps a word: places up to 1.8 n are inside most windows.
        rng = np.random.default_rng([seed, walk, n])
        places = rng.integers(0, max(1, int(1.8 * n)), (len(own), SAMPLED))
        steps = np.unique(places)
        out = embed(words, starts, n, walk, steps)
        for k, table in enumerate(own):
            cells = out[:, np.searchsorted(steps, places[k])]
            key = np.full(len(starts), table + 1, np.uint64)
            for c in range(SAMPLED):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + (cells[:, c] + 3).astype(np.uint64))
            keys[:, table] = np.where((cells < 0).any(axis=1), 0, key)
    return keys


def occurrence(item: list[int], words: list[int], limit: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best approximate occurrence of the item in the words, if within the limit; of equal ones
    the first to end, then the first to start. Only places that a path within the limit can reach are computed."""
    n, m, far = len(item), len(words), (limit + 1, 0)
    before = [(0, j) for j in range(m + 1)]
    for i, x in enumerate(item, 1):
        # The first words of the item may be deleted; the last ones must still fit in.
        lo, hi = max(1, i - limit), min(m, m - n + i + limit)
        now = [far] * (m + 1)
        now[0] = (i, 0)
        best_here = i
        for j in range(lo, hi + 1):
            a, b, c = before[j - 1], before[j], now[j - 1]
            best = (a[0] + (x != words[j - 1]), a[1])
            if b[0] + 1 < best[0]:
                best = (b[0] + 1, b[1])
            if c[0] + 1 < best[0]:
                best = (c[0] + 1, c[1])
            now[j] = best
            if best[0] < best_here:
                best_here = best[0]
        if best_here > limit:
            return None
        before = now
    cost, end, start = min((v[0], j, v[1]) for j, v in enumerate(before))
    return (cost, start, end) if cost <= limit else None


def slices(batch: pa.RecordBatch, column: int, rows: int = 1024, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most so many rows and, unless one text is longer, so many bytes of text."""
    lengths = [0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()]
    at, held = 0, 0
    for i, n in enumerate(lengths):
        if i > at and (i - at == rows or held + n > size):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(lengths):
        yield batch.slice(at)


@dataclass
class Items:
    """A block of benchmark items, prepared for the search."""

    ids: list[int]
    words: list[list[int]]
    vocabulary: dict[str, int]
    limits: list[int]
    limit_of: dict[int, int]
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    tables: dict[int, dict[int, list[int]]]
    n_tables: int


def prepare(items: list[tuple[int, str | None]], share: float, recall: float) -> Items:
    vocabulary: dict[str, int] = {}
    ids, words = [], []
    for item, text in items:
        found = [vocabulary.setdefault(w, len(vocabulary)) for w in TOKEN.findall((text or "").lower())]
        if found and item is not None:
            ids.append(item)
            words.append(found)
    limits = [edits_allowed(len(w), share) for w in words]
    n_tables = tables_for(recall)
    # Codes of the items' runs, sorted, with the item lengths and offsets at which each occurs.
    places: dict[int, set] = defaultdict(set)
    for w, limit in zip(words, limits):
        k = run_length(len(w), limit)
        for i in range(len(w) - k + 1):
            places[k].add((*w[i : i + k], len(w), i))
    runs = {}
    for k, found in places.items():
        rows = np.array(sorted(found), np.int64)
        code = run_codes(rows[:, :k].ravel(), k)[::k]
        order = np.argsort(code, kind="stable")
        code, rows = code[order], rows[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        runs[k] = (code[first], np.append(first, len(code)), rows[:, k], rows[:, k + 1])
    tables: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for i, w in enumerate(words):
        for key in np.unique(sampled_keys(np.array(w, np.int64), np.zeros(1, np.int64), len(w), n_tables)).tolist():
            if key:
                tables[len(w)][key].append(i)
    return Items(ids, words, vocabulary, limits, {len(w): x for w, x in zip(words, limits)}, runs, {n: dict(t) for n, t in tables.items()}, n_tables)


def run_codes(words: np.ndarray, k: int) -> np.ndarray:
    """A number for each run of k known words (ids below 2**21); -1 where one is unknown."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    code, known = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(k):
        part = words[i : i + n]
        known &= part >= 0
        code = code << 21 | np.maximum(part, 0)
    return np.where(known, code, -1)


def search(texts: list[str | None], items: Items) -> list[tuple[int, int, int, int, int]]:
    """(text index, item index, edits, first word, end word) of the best occurrence of each item in each text."""
    get = items.vocabulary.get
    lists = [[get(w, -1) for w in TOKEN.findall((t or "").lower())] for t in texts]
    gap = max((len(w) for w in items.words), default=0) + 1
    # All texts in one array, apart by more unknown words than any window has; a window may begin before the first text too.
    bounds = gap + np.cumsum([0] + [len(x) + gap for x in lists])
    words = np.full(bounds[-1] + gap, -1, np.int64)
    for x, at in zip(lists, bounds.tolist()):
        words[at : at + len(x)] = x
    windows: dict[int, list[np.ndarray]] = defaultdict(list)
    for k, (codes, first, lengths, offsets) in items.runs.items():
        found = run_codes(words, k)
        at = np.flatnonzero(found >= 0)
        if not len(at):
            continue
        where = np.minimum(np.searchsorted(codes, found[at]), len(codes) - 1)
        hit = codes[where] == found[at]
        at, where = at[hit], where[hit]
        if not len(at):
            continue
        count = first[where + 1] - first[where]
        row = np.repeat(first[where] - np.cumsum(count) + count, count) + np.arange(count.sum())
        place, n = np.repeat(at, count), lengths[row]
        start = place - offsets[row]
        order = np.argsort(n, kind="stable")
        cuts = np.flatnonzero(np.diff(n[order])) + 1
        for part in np.split(order, cuts):
            length = int(n[part[0]])
            limit = items.limit_of[length]
            if run_length(length, limit) != k:
                continue
            places, starts = np.unique(place[part]), np.unique(start[part])
            reach = np.searchsorted(places, starts + length + limit) - np.searchsorted(places, starts - limit)
            windows[length].append(starts[reach >= max(1, length - k + 1 - k * limit)])
    pairs: set[tuple[int, int]] = set()
    for n, parts in windows.items():
        starts = np.unique(np.concatenate(parts))
        starts = starts[(starts >= 0) & (starts + n <= len(words))]
        table = items.tables.get(n)
        if table is None or not len(starts):
            continue
        known = np.array(sorted(table), np.uint64)
        for lo in range(0, len(starts), 1 << 15):
            part = starts[lo : lo + (1 << 15)]
            keys = sampled_keys(words, part, n, items.n_tables)
            where = np.minimum(np.searchsorted(known, keys.ravel()), len(known) - 1)
            hit = np.flatnonzero((known[where] == keys.ravel()) & (keys.ravel() != 0))
            for h in np.unique(np.stack([part[hit // items.n_tables], keys.ravel()[hit].view(np.int64)]), axis=1).T.tolist() if len(hit) else []:
                pairs.update((h[0], i) for i in table[h[1] & ((1 << 64) - 1)])
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for start, i in sorted(pairs):
        n, limit = len(items.words[i]), items.limits[i]
        text = int(np.searchsorted(bounds, start + n // 2, side="right")) - 1
        lo, hi = max(int(bounds[text]), start - limit), min(int(bounds[text]) + len(lists[text]), start + n + limit)
        if (have := best.get((text, i))) and have[0] == 0:
            continue
        near = words[lo:hi].tolist()
        present = set(near)
        if sum(w not in present for w in items.words[i]) > limit:
            continue
        if found := occurrence(items.words[i], near, limit):
            found = (found[0], found[1] + lo - int(bounds[text]), found[2] + lo - int(bounds[text]))
            best[text, i] = min(have or found, found)
    return [(t, i, *v) for (t, i), v in sorted(best.items())]


def item_blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of bounded size: the driver holds one partition and one block at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_id).cast("long"), F.col(text)).toLocalIterator():
        block.append((row[0], row[1]))
        size += len((row[1] or "").split())
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, recall: float = 0.95, item_id: str = "item_id", text: str = "text", step: int = 1024) -> DataFrame:
    """Rows ``(doc_id, item_id, edits, first_word, end_word)``: the best occurrence of each item in each document, within
    ``share`` times the item's words in word edits."""
    rows = docs.select(column_or_null(docs, "doc_id", "long").alias("doc_id"), column_or_null(docs, "text", "string").alias("text"))
    schema = "doc_id long, item_id long, edits int, first_word int, end_word int"
    context = docs.sparkSession.sparkContext

    def searcher(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                for part in slices(batch, 1, step):
                    ids = part.column(0).to_pylist()
                    found = search(part.column(1).to_pylist(), items)
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([ids[t] for t, *_ in found], pa.int64()), pa.array([items.ids[i] for _, i, *_ in found], pa.int64()), *(pa.array([x[c] for x in found], pa.int32()) for c in (2, 3, 4))], ["doc_id", "item_id", "edits", "first_word", "end_word"])

        return run

    out = None
    for block in item_blocks(benchmark, item_id, text):
        found = rows.mapInArrow(searcher(context.broadcast(prepare(block, share, recall))), schema)
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, recall: float = 0.95) -> DataFrame:
    """``docs`` without the documents that hold an item; one pass, no shuffle, for each block of items."""
    at, schema, context = docs.columns.index("text"), docs.schema, docs.sparkSession.sparkContext

    def keeper(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, at):
                    keep = np.ones(part.num_rows, bool)
                    keep[[t for t, *_ in search(part.column(at).to_pylist(), shared.value)]] = False
                    yield part.filter(pa.array(keep))

        return run

    for block in item_blocks(benchmark, "item_id", "text"):
        docs = docs.mapInArrow(keeper(context.broadcast(prepare(block, share, recall))), schema)
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
