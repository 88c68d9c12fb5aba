"""Phrase collocations: dictionary-encoded n-grams as fixed-width keys, sorted by ranges and counted as runs.

1. Texts, lower-cased and cut into pieces, are packed by language into chunks of bounded size, a table bucketed by part (some
   chunks of one task). Each part counts its words; the sums of a word and language that reach the least count are the
   dictionary, whose entries have dense numbers. Of a word's number every part that holds it is told once.
2. Each part writes its text as numbers: a word outside the dictionary, or the end of a piece, is a break. No phrase over a
   break can reach the least count, since none is more frequent than its words.
3. Pairs, then triples of numbers become keys of 16 bytes (five a word, most significant first). A part sorts its keys by
   radix and sends each distinct one with its count, packed, to the range that holds it; ranges are cut at quantiles of a
   sample of keys, in number proportional to all keys. A range sorts what it receives by radix and counts runs. A key that a
   third of all texts hold is one entry a part.
   For pairs, a range also tells each part which of its keys reached the least count, one bit a key: a triple is made only
   where both of its pairs did, which again loses none.
4. Scores are joins of phrases with the counts of their parts, on keys that may be hot (``join_split``), in decimals: a**2
   times a million keeps within 38 digits up to a = 10**16.

Defined results: a null text is empty, a null language is ``und`` (with those that say so); ids, other columns and the order
of rows do not matter; repeated rows count again; an empty table gives an empty result. Texts are counted whole; one without
any separator for longer than a chunk is one chunk. Of cuts that tie the first counts; phrases that tie in score and count
follow in byte order.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column_or_null, forget, join_split, materialize, mix64, shared_folder

#: Bytes of text of a chunk, of all that a task holds back, and chunks of a part.
CHUNK_BYTES = 4_000_000
HELD_BYTES = 16_000_000
PART_CHUNKS = 4
#: Keys of a range, about; of which one in SAMPLED is in the sample that cuts the ranges; and ranges, at most (16 bytes each).
RANGE_KEYS = 1 << 20
SAMPLED = 1 << 12
MOST_RANGES = 1 << 20
#: Bits of a word's number.
ID_BITS = 40
FORMS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ")
#: A word of its own that no text holds, as a full stop ends pieces.
END = b" . "


def plain(text: bytes | None) -> bytes:
    """Lower-cased, pieces as lines, tabs as spaces."""
    return (text or b"").translate(FORMS)


def bucketed(df: DataFrame, name: str, buckets: int) -> tuple[DataFrame, str]:
    """``df`` written as a table bucketed by part, so that grouping by part moves nothing; and its name."""
    spark, name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "none").option("path", f"{shared_folder(spark)}/{name}").bucketBy(buckets, "part").format("parquet").saveAsTable(name)
    return spark.table(name), name


def drop_bucketed(table: DataFrame, name: str) -> None:
    forget(table)
    table.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def _chunks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk = TaskContext.get().partitionId() << 24, 0
        held: dict[str, list[bytes]] = {}
        sizes: Counter = Counter()

        def out(lang: str) -> pa.RecordBatch:
            nonlocal part, chunk
            data = zstandard.ZstdCompressor(level=1).compress(b"\n".join(held.pop(lang)))
            del sizes[lang]
            record = pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([chunk], pa.int32()), pa.array([lang]), pa.array([data], pa.binary())], ["part", "chunk", "lang", "data"])
            chunk += 1
            if chunk == PART_CHUNKS:
                part, chunk = part + 1, 0
            return record

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                text = plain(text.as_py())
                at = 0
                while at < len(text):
                    # A long text is cut at the end of a piece.
                    to = len(text) if len(text) - at <= size else text.find(b"\n", at + size)
                    to = len(text) if to < 0 else to
                    held.setdefault(lang, []).append(text[at:to])
                    sizes[lang] += to - at + 1
                    at = to + 1
                    if sizes[lang] >= size:
                        yield out(lang)
                while sizes.total() > HELD_BYTES:
                    yield out(sizes.most_common(1)[0][0])
        for lang in list(held):
            yield out(lang)

    return run


def _words_of_part(table: pa.Table) -> pa.Table:
    found: dict[str, Counter] = {}
    for lang, data in zip(table.column("lang").to_pylist(), table.column("data")):
        found.setdefault(lang, Counter()).update(zstandard.ZstdDecompressor().decompress(data.as_py()).split())
    part, tables = table.column("part")[0].as_py(), []
    for lang in list(found):
        counts = found.pop(lang)
        n = len(counts)
        tables.append(pa.table([pa.repeat(pa.scalar(part, pa.int64()), n), pa.repeat(pa.scalar(lang, pa.string()), n), pa.array(counts, pa.binary(), size=n).cast(pa.string()), pa.array(counts.values(), pa.int64(), size=n)], ["part", "lang", "word", "n"]))
    return pa.concat_tables(tables)


def press_ids(ids: np.ndarray) -> bytes:
    width = 4 if not len(ids) or int(ids.max()) < 1 << 31 else 8
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(ids.astype(f"<i{width}").tobytes())


def read_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"<i{data[0]}").astype(np.int64)


def _encode(left: pa.Table, right: pa.Table) -> pa.Table:
    numbers: dict[str, dict[bytes, int]] = {}
    for lang, word, number in zip(right.column("lang").to_pylist(), right.column("word").cast(pa.binary()).to_pylist(), right.column("id").to_pylist()):
        numbers.setdefault(lang, {})[word] = number
    parts, chunks, blobs = [], [], []
    for part, chunk, lang, data in zip(left.column("part").to_pylist(), left.column("chunk").to_pylist(), left.column("lang").to_pylist(), left.column("data")):
        known = numbers.get(lang)
        if not known:
            continue
        words = zstandard.ZstdDecompressor().decompress(data.as_py()).replace(b"\n", END).split()
        ids = np.fromiter(map(known.get, words, repeat(0)), np.int64, len(words))
        # Words between two breaks form no phrase, and one break is as good as many.
        some = ids > 0
        near = np.concatenate([[False], some[:-1]]) | np.concatenate([some[1:], [False]]) if len(ids) else some
        ids = np.where(some & near, ids, 0)
        ids = ids[(ids > 0) | np.concatenate([[True], ids[:-1] > 0])] if len(ids) else ids
        parts.append(part)
        chunks.append(chunk)
        blobs.append(press_ids(ids))
    return pa.table([pa.array(parts, pa.int64()), pa.array(chunks, pa.int32()), pa.array(blobs, pa.binary())], ["part", "chunk", "data"])


def packed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Keys of 16 bytes as two numbers each: five bytes a word and one that is 0."""
    a, b, c = (x.astype(np.uint64) for x in (a, b, c))
    return np.stack([a << np.uint64(24) | b >> np.uint64(16), b << np.uint64(48) | c << np.uint64(8)], axis=1)


def unpacked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hi, lo = keys[:, 0], keys[:, 1]
    a, b = hi >> np.uint64(24), (hi & np.uint64(0xFFFFFF)) << np.uint64(16) | lo >> np.uint64(48)
    return a.astype(np.int64), b.astype(np.int64), (lo >> np.uint64(8) & np.uint64((1 << ID_BITS) - 1)).astype(np.int64)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """Stable order of the keys, by digits of 16 bits from the last; numpy sorts such digits by radix."""
    order = np.arange(len(keys))
    for word in (1, 0):
        for shift in (0, 16, 32, 48):
            digit = (keys[:, word] >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, in sorted keys."""
    return np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else np.zeros(0, np.int64)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the length of each run."""
    keys = keys[radix_order(keys)]
    start = runs(keys)
    return keys[start], np.diff(np.append(start, len(keys)))


def pair_places(ids: np.ndarray) -> np.ndarray:
    return np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0)) if len(ids) > 1 else np.zeros(0, np.int64)


def pairs_of(ids: np.ndarray) -> np.ndarray:
    at = pair_places(ids)
    return packed(ids[at], ids[at + 1], np.zeros(len(at)))


def range_of(keys: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """The range of sorted keys: how many splits are no greater."""
    if not len(splits):
        return np.zeros(len(keys), np.int64)
    kind = np.dtype([("hi", "<u8"), ("lo", "<u8")])
    return np.searchsorted(np.ascontiguousarray(splits).view(kind).ravel(), np.ascontiguousarray(keys).view(kind).ravel(), side="right")


def press_keys(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys as differences of the first numbers, then the second ones, and their counts."""
    first = np.diff(keys[:, 0], prepend=np.uint64(0)).astype("<u8")
    columns = [first, keys[:, 1] >> np.uint64(8), n.astype(np.int64)]
    # Bytes of one significance stand together, which presses well.
    planes = [np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
    return len(keys).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def read_keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8).reshape(3, 8, n)
    first, second, count = (np.ascontiguousarray(p.T).view("<u8").ravel() for p in planes)
    return np.stack([np.cumsum(first, dtype=np.uint64), second << np.uint64(8)], axis=1), count.astype(np.int64)


def sampled(keys: np.ndarray, share: int) -> np.ndarray:
    """Keys of which a hash is divisible by ``share``."""
    return keys[mix64(keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) + keys[:, 1]) % np.uint64(share) == 0]


def _sample(make, share: int):
    """(hi, lo) of the sampled keys of each row, and with both null how many keys there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for args in zip(*(c.to_pylist() for c in batch.columns)):
                keys = make(*args)
                some = np.unique(sampled(keys, share).view(np.int64).reshape(-1, 2), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([*some[:, 0].tolist(), None], pa.int64()), pa.array([*some[:, 1].tolist(), None], pa.int64()), pa.array([*[1] * len(some), len(keys)], pa.int64())], ["hi", "lo", "n"])

    return run


def splits_of(rows: DataFrame, make, range_keys: int, share: int) -> np.ndarray:
    """Keys at which the ranges are cut: quantiles of the sample, one each ``range_keys`` keys, on the driver."""
    spark = rows.sparkSession
    found = materialize(rows.mapInArrow(_sample(make, share), "hi long, lo long, n long"), "phrase-sample")
    total = found.filter("hi is null").agg(F.sum("n")).first()[0] or 0
    n_ranges = min(MOST_RANGES, max(spark.sparkContext.defaultParallelism, total // range_keys))
    # In unsigned order. Of each sorted partition every step-th key is a cut: only cuts reach the driver, 16 bytes each.
    unsigned = lambda c: F.col(c).bitwiseXOR(F.lit(-(1 << 63))).alias(c)
    keys = found.filter("hi is not null").select(unsigned("hi"), unsigned("lo")).distinct()
    step = max(1, keys.count() // n_ranges)
    ordered = keys.repartitionByRange("hi", "lo").sortWithinPartitions("hi", "lo").withColumn("at", F.monotonically_increasing_id())
    cut = ordered.filter(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) % step == step - 1).select("hi", "lo").collect()
    forget(found)
    keys = np.array([(r.hi, r.lo) for r in cut], np.int64).reshape(-1, 2).view(np.uint64) ^ np.uint64(1 << 63)
    return keys[np.lexsort((keys[:, 1], keys[:, 0]))]


SENT = "bucket int, part long, chunk int, data binary"
COUNTED = "first long, second long, third long, n long, part long, chunk int, bucket int, bits binary"
_COUNTED = pa.schema([*((c, pa.int64()) for c in ("first", "second", "third", "n", "part")), ("chunk", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])


def _send(make, splits: np.ndarray):
    """Each row's distinct keys with their counts, to the ranges that hold them. make: columns after part and chunk to keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, chunk, *args in zip(*(c.to_pylist() for c in batch.columns)):
                keys, n = counted(make(*args))
                to = range_of(keys, splits)
                start = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
                out = [(int(to[a]), part, chunk, press_keys(keys[a:b], n[a:b])) for a, b in zip(start.tolist(), np.append(start[1:], len(to)).tolist())]
                for lo in range(0, len(out), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[lo : lo + 256]), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["bucket", "part", "chunk", "data"])

    return run


def _count_range(least: int, answer: bool):
    """Keys of a range that reach the least count; and, to each sender, one bit for each key that it sent."""

    def run(table: pa.Table) -> pa.Table:
        found = [read_keys(d.as_py()) for d in table.column("data")]
        keys, n = np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found])
        sizes = [len(k) for k, _ in found]
        order = radix_order(keys)
        keys, n = keys[order], n[order]
        start = runs(keys)
        total = np.add.reduceat(n, start) if len(start) else n
        often = total >= least
        a, b, c = unpacked(keys[start[often]])
        out = [pa.table([pa.array(a), pa.array(b), pa.array(c), pa.array(total[often]), *(pa.nulls(len(a), f.type) for f in list(_COUNTED)[4:])], schema=_COUNTED)]
        if answer:
            flags = np.zeros(len(keys), bool)
            flags[order] = np.repeat(often, np.diff(np.append(start, len(keys))))
            ends = np.cumsum(sizes)
            bits = [np.packbits(flags[e - s : e]).tobytes() for s, e in zip(sizes, ends.tolist())]
            keep = pa.array([any(x) for x in bits])
            told = pa.table([*(pa.nulls(len(bits), pa.int64()) for _ in range(4)), table.column("part"), table.column("chunk"), table.column("bucket"), pa.array(bits, pa.binary())], schema=_COUNTED)
            out.append(told.filter(keep))
        return pa.concat_tables(out)

    return run


def _triples(splits: np.ndarray):
    """Chunks with their answers: triples of which both pairs reached the least count."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        bits = {(c, b): x for c, b, x in zip(*(right.column(c).to_pylist() for c in ("chunk", "bucket", "bits")))}
        parts, chunks, blobs = [], [], []
        for part, chunk, data in zip(*(left.column(c).to_pylist() for c in ("part", "chunk", "data"))):
            ids = read_ids(data)
            at = pair_places(ids)
            keys = packed(ids[at], ids[at + 1], np.zeros(len(at)))
            order = radix_order(keys)
            keys = keys[order]
            start = runs(keys)
            to = range_of(keys[start], splits)
            often = np.zeros(len(start), bool)
            for b in np.unique(to).tolist():
                if (chunk, b) in bits:
                    a, e = np.searchsorted(to, [b, b + 1])
                    often[a:e] = np.unpackbits(np.frombuffer(bits[chunk, b], np.uint8), count=e - a)
            flags = np.zeros(len(at), bool)
            flags[order] = np.repeat(often, np.diff(np.append(start, len(keys))))
            good = np.zeros(len(ids) + 1, bool)
            good[at[flags]] = True
            first = np.flatnonzero(good[:-1] & good[1:]) if len(ids) else at
            parts.append(part)
            chunks.append(chunk)
            blobs.append(press_ids(np.stack([ids[first], ids[first + 1], ids[first + 2]], axis=1).ravel() if len(first) else ids[:0]))
        return pa.table([pa.array(parts, pa.int64()), pa.array(chunks, pa.int32()), pa.array(blobs, pa.binary())], ["part", "chunk", "data"])

    return run


def _keys_of_pairs(data: bytes) -> np.ndarray:
    return pairs_of(read_ids(data))


def _keys_of_triples(data: bytes) -> np.ndarray:
    ids = read_ids(data).reshape(-1, 3)
    return packed(ids[:, 0], ids[:, 1], ids[:, 2])


def attach(rows: DataFrame, facts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of the written table ``rows`` with the one row a key of ``facts``, hot keys split, as a written table."""
    copies = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    joined = materialize(join_split(rows, facts.join(copies, keys), keys, total).drop("copies"), "phrase-facts")
    forget(rows)
    return joined


def dense(df: DataFrame, name: str) -> DataFrame:
    """``df`` written with id: 1, 2, ... in any order."""
    table = materialize(df.withColumn("at", F.monotonically_increasing_id()), name)
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before, offsets = 0, []
    for p, n in sorted(tuple(r) for r in table.groupBy(part.alias("p")).agg(F.count(F.lit(1))).collect()):
        offsets.append((p, before))
        before += n
    if before >= 1 << ID_BITS:
        raise ValueError(f"more than 2**{ID_BITS} frequent words")
    # One row a partition.
    offsets = df.sparkSession.createDataFrame(offsets, "p long, before long")
    return table.join(F.broadcast(offsets), part == F.col("p")).withColumn("id", F.col("before") + place + 1).drop("at", "p", "before")


def score(left: str, right: str) -> Column:
    """floor(1000000 a a / (left right)), exactly."""
    whole = lambda c: f"CAST({c} AS DECIMAL(16, 0))"
    return F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * ({whole('a')} * {whole('a')})) div ({whole(left)} * {whole(right)})")


def counted_phrases(coded: DataFrame, make, least: int, answer: bool, range_keys: int, share: int, name: str) -> tuple[DataFrame, np.ndarray]:
    """The written result of ``_count_range`` over the keys of all chunks, and the cuts of its ranges."""
    splits = splits_of(coded.select("data"), make, range_keys, share)
    sent = coded.select("part", "chunk", "data").mapInArrow(_send(make, splits), SENT)
    return materialize(sent.groupBy("bucket").applyInArrow(_count_range(least, answer), COUNTED), name), splits


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, cover: int = 50, range_keys: int = RANGE_KEYS, share: int = SAMPLED, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The ``top`` phrases of two or three words of each language: lang, rank, phrase, a, l, r, n, score.

    least: how often a phrase occurs; cover: a phrase goes if a longer one that holds it has so many hundredths of its count.
    """
    rows = docs.select(F.coalesce(column_or_null(docs, "lang", "string"), F.lit("und")).alias("lang"), column_or_null(docs, "text", "string").alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(100_000, max(2 * docs.sparkSession.sparkContext.defaultParallelism, n_bytes // (PART_CHUNKS * CHUNK_BYTES)))
    chunks, chunks_name = bucketed(rows.mapInArrow(_chunks(chunk_bytes), "part long, chunk int, lang string, data binary"), "phrase_chunks", buckets)
    words = materialize(chunks.groupBy("part").applyInArrow(_words_of_part, "part long, lang string, word string, n long"), "phrase-words")
    often = words.groupBy("lang", "word").agg(F.sum("n").alias("f"), F.count(F.lit(1)).alias("copies")).filter(F.col("f") >= least)
    dictionary = materialize(dense(often, "phrase-often"), "phrase-dictionary")
    sizes = materialize(words.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-sizes")
    answers = join_split(words.select("part", "lang", "word"), dictionary.select("lang", "word", "id", "copies"), ["lang", "word"], words.count())
    coded = chunks.groupBy("part").cogroup(answers.select("part", "lang", "word", "id").groupBy("part")).applyInArrow(_encode, "part long, chunk int, data binary")
    coded, coded_name = bucketed(coded, "phrase_ids", buckets)
    drop_bucketed(chunks, chunks_name)
    forget(words)
    found, splits = counted_phrases(coded, _keys_of_pairs, least, True, range_keys, share, "phrase-pairs")
    pairs = materialize(found.filter("n is not null").select("first", "second", F.col("n").alias("a")), "phrase-often-pairs")
    told = found.filter("part is not null").select("part", "chunk", "bucket", "bits")
    places = materialize(coded.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(_triples(splits), "part long, chunk int, data binary"), "phrase-places")
    drop_bucketed(coded, coded_name)
    forget(found)
    found, _ = counted_phrases(places, _keys_of_triples, least, False, range_keys, share, "phrase-triples")
    triples = materialize(found.select("first", "second", "third", F.col("n").alias("a")), "phrase-often-triples")
    forget(places, found)
    n_two, n_three = pairs.count(), triples.count()
    word = lambda at, *more: dictionary.select(F.col("id").alias(at), F.col("word").alias(f"{at}_word"), F.col("f").alias(f"{at}_n"), *more)
    pair = lambda p, q: pairs.select(F.col("first").alias(p), F.col("second").alias(q), F.col("a").alias(f"{p}_{q}_n"))
    # Pairs, less those that a triple covers.
    inside = triples.select("first", "second", "a").unionAll(triples.select("second", "third", "a")).groupBy("first", "second").agg(F.max("a").alias("longer"))
    two = pairs.join(inside, ["first", "second"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a"))).drop("longer")
    two = attach(attach(materialize(two, "phrase-facts"), word("first", "lang"), ["first"], n_two), word("second"), ["second"], n_two)
    two = two.select("lang", F.concat_ws(" ", "first_word", "second_word").alias("phrase"), "a", F.col("first_n").alias("l"), F.col("second_n").alias("r"), score("first_n", "second_n").alias("score"))
    three = attach(triples, word("first", "lang"), ["first"], n_three)
    for facts, keys in ((pair("first", "second"), ["first", "second"]), (pair("second", "third"), ["second", "third"]), (word("second"), ["second"]), (word("third"), ["third"])):
        three = attach(three, facts, keys, n_three)
    cut = F.least(*(F.struct(score(f"{p}_n", f"{q}_n").alias("score"), F.lit(k).alias("k"), F.col(f"{p}_n").alias("l"), F.col(f"{q}_n").alias("r")) for k, p, q in ((1, "first", "second_third"), (2, "first_second", "third"))))
    three = three.withColumn("cut", cut).select("lang", F.concat_ws(" ", "first_word", "second_word", "third_word").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = two.unionByName(three).withColumn("rank", place.cast("long")).filter(F.col("rank") <= top)
    # At most ``top`` rows a language meet its size.
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
