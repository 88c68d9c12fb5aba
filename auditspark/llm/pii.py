"""Personal data: patterns, and information-theoretic sanitisation of the terms that reveal it.

Base patterns find protected entities. Every entity is a concept of the corpus, and so are each kind of entity and all of
them together; the ``REACH`` terms (words of three letters or more) on either side of it are its context, however far they
are. With positions of words as the sample space, E the positions near concept e and T those of term t,

    disclosure(t, e) = PMI(T; E) / IC(E) = log(P(E | T) / P(E)) / -log P(E)

is the share of the concept's information that the term gives away: 1 if the term occurs near it only, 0 if it is
independent of it. P(E | T) is the lower confidence bound (Wilson) of the share of the term's occurrences that are near e,
where equal contexts (copies of one passage) count once: few occurrences lower the disclosure, but no entity is too rare to
have any. As IC grows with the corpus, the bound must reach ``least_share`` too, which means the same at every size. Terms
that exceed both are spans too, wherever they occur; sanitising generalises them to the kind of what they reveal.

Defined results: a null text is empty; repeated rows each get a row; an empty table gives an empty result; other columns
are ignored or passed through. Of several kinds that a term reveals equally the later in KINDS counts. Of spans that
overlap the leftmost names the replacement, then the shortest. Terms that touch a base span are no spans. Long texts are
scanned whole, in linear time.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import FEW_KEYS, column_or_null, few, fresh, is_empty, join_split, materialize

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Possessive runs that start where a run of digits starts: a later start could match nothing more.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
REACH = 6
THRESHOLD, LEAST_SHARE = 0.8, 0.2
#: Bits for each term in the table of disclosing terms that tasks get, and its greatest size (64 MB): what it passes is
#: joined exactly, so a fuller table only passes more.
TERM_BITS = 16
MAX_BITS = 1 << 29
#: Terms that a task counts before it emits them.
HELD = 100_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of the email pattern: each match has one @, so each run before an @ is walked once."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            found.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), leftmost non-overlapping within each kind."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:] if len(x) > 4 else x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def digest(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def entity_of(kind: int, text: str) -> str:
    """One value, however it is written: an address in lower case, an IP's numbers, a number's digits."""
    if kind == 0:
        return text.lower()
    if kind == 1:
        return ".".join(str(int(x[-4:])) for x in text.split("."))
    return "".join(filter(str.isdigit, text))


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[list[tuple[int, str]]]:
    """For each span up to REACH terms on either side, in lower case, with their places; terms that overlap it are none."""
    terms = [(m.start(), m.end(), m[0].lower()) for m in TERM.finditer(text)] if spans else []
    starts, ends = [t[0] for t in terms], [t[1] for t in terms]
    found = []
    for start, _, end in spans:
        before, after = bisect_right(ends, start), bisect_left(starts, end)
        found.append([(t[0], t[2]) for t in terms[max(0, before - REACH) : before] + terms[after : after + REACH]])
    return found


#: fresh: bits of the levels (entity, kind, all) of which no earlier span has counted this occurrence of the term.
SCAN = "doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, words long, near array<struct<entity:long,kind:int,context:long,terms:array<struct<term:string,fresh:int>>>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    near_type = pa.list_(pa.struct([("entity", pa.int64()), ("kind", pa.int32()), ("context", pa.int64()), ("terms", pa.list_(pa.struct([("term", pa.string()), ("fresh", pa.int32())])))]))
    for batch in batches:
        keys, counts, shas, bases, words, near = [], [[], [], [], []], [], [], [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            spans = base_spans(text)
            n = Counter(k for _, k, _ in spans)
            for k in range(4):
                counts[k].append(n[k])
            bases.append(digest(spans))
            shas.append(hashlib.sha256(bases[-1].encode()).hexdigest())
            keys.append(signed(xxh64_intdigest(text.encode(), 42)))
            words.append(len(text.encode().split()))
            found, seen = [], set()
            for (s, k, e), around in zip(spans, contexts(text, spans)):
                entity = signed(xxh64_intdigest(f"{k}:{entity_of(k, text[s:e])}".encode()))
                terms = []
                for place, term in around:
                    marks = [(0, entity, place), (1, k, place), (2, 0, place)]
                    terms.append({"term": term, "fresh": sum(1 << m[0] for m in marks if m not in seen)})
                    seen.update(marks)
                found.append({"entity": entity, "kind": k, "context": signed(xxh64_intdigest(" ".join(t for _, t in around).encode())), "terms": terms})
            near.append(found)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(bases, pa.string()), pa.array(words, pa.int64()), pa.array(near, near_type)],
            ["doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "words", "near"])


def table_of(terms: DataFrame) -> np.ndarray:
    """A bit for each hash value of ``terms(term)``, TERM_BITS bits a term up to MAX_BITS; merged on the driver by blocks."""
    bits = min(MAX_BITS, max(1 << 16, 1 << (TERM_BITS * terms.count()).bit_length()))
    table = np.zeros(bits // 8, np.uint8)
    cell = F.pmod(F.xxhash64("term"), F.lit(bits)).cast("int")
    # One number a byte of the table at most.
    for row in terms.select((cell / 8).cast("int").alias("at"), (cell % 8).alias("bit")).groupBy("at").agg(F.bit_or(F.expr("shiftleft(1, bit)")).alias("byte")).toLocalIterator():
        table[row["at"]] = row["byte"]
    return table


def listed(terms, table: np.ndarray) -> list[str]:
    """Those terms that the table may hold."""
    cells = [(t, signed(xxh64_intdigest(t.encode(), 42)) % (8 * len(table))) for t in terms]
    return [t for t, cell in cells if table[cell >> 3] >> (cell & 7) & 1]


def count_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows ``(term, total)``: occurrences of the given terms in all texts of ``rows(doc_id, text)``. All words are counted,
    combined by task, so no list of terms is sent to the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["term", "total"])

        for batch in batches:
            for text in batch.column(1):
                held.update(TERM.findall((text.as_py() or "").lower()))
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    found = rows.mapInArrow(run, "term string, total long")
    return found.groupBy("term").agg(F.sum("total").alias("total")).join(terms.select("term").distinct(), "term", "left_semi")


def free_of(hits: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Of sorted hits those that touch no base span; both are walked once."""
    ends = accumulate((e for _, _, e in base), max)
    reach = list(ends)
    starts = [s for s, _, _ in base]
    kept = []
    for start, end in hits:
        # All base spans that begin before the hit's end: the farthest end among them decides.
        n = bisect_left(starts, end)
        if not n or reach[n - 1] <= start:
            kept.append((start, end))
    return kept


def find_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows ``(doc_id, text_key, start, end, kind)``: where the terms of ``terms(term, kind)`` occur, outside base spans."""
    table = rows.sparkSession.sparkContext.broadcast(table_of(terms))
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {t.lower() for t in TERM.findall(text or "")}
                if len(known) > 200_000:
                    known.clear()
                new = [t for t in found if t not in known]
                known.update(dict.fromkeys(new, False) | dict.fromkeys(listed(new, table.value), True))
                hits = {t for t in found if known[t]}
                if hits:
                    spans = free_of([m.span() for m in TERM.finditer(text) if m[0].lower() in hits], base_spans(text))
                    key = signed(xxh64_intdigest(text.encode(), 42))
                    out += [(doc, key, text[s:e].lower(), s, e) for s, e in spans]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    found = rows.mapInArrow(run, "doc_id long, text_key long, term string, start int, end int").distinct()
    # A term may occur in a third of all documents: hot terms are joined by a broadcast of bounded size.
    found = materialize(found, "pii-found")
    uses = found.groupBy("term").agg(F.count(F.lit(1)).alias("copies"))
    return join_split(found, terms.select("term", "kind").distinct().join(uses, "term"), ["term"], found.count()).select("doc_id", "text_key", "start", "end", "kind")


def disclosing_terms(rows: DataFrame, scanned: DataFrame, threshold: float, z: float, least_share: float) -> DataFrame | None:
    """Rows ``(term, kind, disclosure)`` of the terms that reach the threshold and the least share; None if there are none."""
    near = scanned.filter(F.size("near") > 0).select(F.inline("near"))
    level = lambda n, of: F.struct(F.lit(n).alias("level"), of.cast("long").alias("of"))
    levels = F.array(level(0, F.col("entity")), level(1, F.col("kind")), level(2, F.lit(0)))
    counted = near.select("entity", "kind", "context", F.inline("terms")).select("kind", "context", "term", "fresh", F.inline(levels)).filter("shiftright(fresh, level) & 1 = 1")
    one = counted.groupBy("level", "of", "kind", "term", "context").agg(F.count(F.lit(1)).alias("n"))
    kinds = one.groupBy("level", "of", "kind", "term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("contexts"))
    pairs = kinds.groupBy("level", "of", "term").agg(F.sum("n").alias("n"), F.sum("contexts").alias("contexts"), F.max_by("kind", F.struct("contexts", "kind")).alias("kind"))
    words = max(2, scanned.agg(F.sum("words")).first()[0] or 0)
    # Kinds and the whole are five rows at most; only entities are joined.
    by_kind = {r[0]: r[1] for r in near.groupBy("kind").count().collect()}
    cover = F.when(F.col("level") == 2, sum(by_kind.values()))
    for kind, spans in by_kind.items():
        cover = cover.when((F.col("level") == 1) & (F.col("of") == kind), spans)
    entities = near.groupBy(F.col("entity").alias("of")).agg(F.count(F.lit(1)).alias("cover"))
    pairs = pairs.filter("level = 0").join(entities, "of").unionByName(pairs.filter("level > 0").withColumn("cover", cover.cast("long")))

    def share(outside):
        """Lower bound of P(E | T) from the contexts that hold the term and its occurrences elsewhere."""
        trials, z2 = F.col("contexts") + outside, z * z
        at = F.col("contexts") / trials
        return (at + z2 / (2 * trials) - z * F.sqrt(at * (1 - at) / trials + z2 / (4 * trials * trials))) / (1 + z2 / trials)

    def discloses(outside):
        return (disclosure(outside) >= threshold) & (share(outside) >= least_share)

    def disclosure(outside):
        of = F.least(F.lit(1.0), F.col("cover") * (2 * REACH) / words)
        return F.log(share(outside) / of) / F.greatest(F.lit(1e-9), -F.log(of))

    # Those that could not reach the threshold if all their occurrences were near need no count.
    pairs = materialize(pairs.filter(discloses(F.lit(0))), "pii-pairs")
    n_pairs = pairs.count()
    if not n_pairs:
        return None
    # A common word may stand near very many entities: hot terms are joined by a broadcast of bounded size.
    # The join reads the totals twice; they are written, so that texts are counted once.
    totals = materialize(count_terms(rows, pairs).join(pairs.groupBy("term").agg(F.count(F.lit(1)).alias("copies")), "term"), "pii-totals")
    outside = F.greatest(F.lit(0), F.col("total") - F.col("n"))
    found = join_split(pairs, totals, ["term"], n_pairs).filter(discloses(outside)).withColumn("disclosure", disclosure(outside))
    best = materialize(found.groupBy("term").agg(F.max_by("kind", F.struct("disclosure", "kind")).alias("kind"), F.max("disclosure").alias("disclosure")), "pii-terms")
    return None if is_empty(best) else best


def found_spans(rows: DataFrame, terms: DataFrame, doc: str, key: str, name: str) -> DataFrame:
    """The terms' occurrences as one row a text that has any, under the given names. They come to the texts if they are few, so
    that texts stay where they are."""
    found = find_terms(rows, terms).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias(name))
    found = materialize(found.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), name), "pii-spans")
    spans = found.agg(F.sum(F.size(name))).first()[0] or 0
    return few(found) if spans <= FEW_KEYS else found


def scan_pii(docs: DataFrame, threshold: float = THRESHOLD, z: float = 1.96, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, text_key, counts, base_sha256, base, terms (array of start, end,
    kind of what the term reveals)."""
    rows = docs.select(column_or_null(docs, "doc_id", "long").alias("doc_id"), column_or_null(docs, "text", "string").alias("text"))
    scanned = materialize(rows.mapInArrow(_scan, SCAN), "pii")
    found = disclosing_terms(rows, scanned, threshold, z, least_share)
    keep = scanned.select("doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base")
    empty = F.expr("cast(array() as array<struct<start:int,end:int,kind:int>>)")
    if found is None:
        return keep.withColumn("terms", empty)
    spans = found_spans(rows, found, "d", "k", "terms")
    joined = keep.join(spans, F.col("text_key").eqNullSafe(F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return joined.select(*keep.columns, F.coalesce("terms", empty).alias("terms"))


def all_spans(base: str, terms: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    spans = [(int(s), KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in base.split(",") if x)]
    return sorted(spans + [(s, 4, e) for s, e, _ in terms])


def sanitise(text: str, base: list[tuple[int, int, int]], terms: list[tuple[int, int, int]]) -> str:
    """The text with each group of overlapping spans replaced by its kind, and terms by what they reveal."""
    marks = sorted([(s, e, f"[{KINDS[k].upper()}]") for s, k, e in base] + [(s, e, f"[{KINDS[k].upper()}-RELATED]") for s, e, k in terms])
    out, at = [], 0
    for s, e, mark in marks:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def sanitise_documents(docs: DataFrame, threshold: float = THRESHOLD, z: float = 1.96, least_share: float = LEAST_SHARE) -> DataFrame:
    """``docs`` with personal data and disclosing terms of the text replaced, and n_chars (if there) counted again."""
    rows = docs.select(column_or_null(docs, "doc_id", "long").alias("doc_id"), column_or_null(docs, "text", "string").alias("text"))
    scanned = materialize(rows.mapInArrow(_scan, SCAN), "pii")
    found = disclosing_terms(rows, scanned, threshold, z, least_share)
    names, schema = docs.columns, docs.schema
    at = names.index("text")
    terms_, d_, k_, key_ = fresh(docs, "_terms", "_d", "_k", "_key")
    if found is not None:
        spans = found_spans(rows, found, d_, k_, terms_)
        keyed = docs.withColumn(key_, F.xxhash64("text"))
        docs = keyed.join(spans, F.col(key_).eqNullSafe(F.col(k_)) & F.col("doc_id").eqNullSafe(F.col(d_)), "left").select(*[f"`{c}`" for c in names], terms_)
    else:
        docs = docs.withColumn(terms_, F.expr("cast(null as array<struct<start:int,end:int,kind:int>>)"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, terms in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                if text:
                    own = [(t["start"], t["end"], t["kind"]) for t in terms or []]
                    base = base_spans(text)
                    text = sanitise(text, base, own) if base or own else text
                out.append(text)
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(out, columns[at].type)
            if "n_chars" in names:
                i = names.index("n_chars")
                columns[i] = pa.array([None if x is None else len(x) for x in out], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("start"), F.when(x.startswith("email"), 0).when(x.startswith("ip"), 1).when(x.startswith("card"), 2).otherwise(3).alias("kind"), x.alias("text")))
    term = F.transform("terms", lambda x: F.struct(x["start"].alias("start"), F.lit(4).alias("kind"), F.concat_ws(":", F.lit("term"), x["start"].cast("string"), x["end"].cast("string")).alias("text")))
    spans = F.array_join(F.transform(F.array_sort(F.concat(base, term)), lambda x: x["text"]), ",")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"), F.size("terms").cast("long").alias("n_term"))
