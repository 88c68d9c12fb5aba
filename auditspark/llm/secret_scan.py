"""Secret scans by corpus-wide ownership frequency.

Every candidate value is hashed; the hashes are counted by distinct repositories and distinct owners over the whole
corpus. A value that many owners hold is an example that was copied around; one that a single owner holds and that looks
random is a live-looking credential. Values are told apart by 128-bit hashes; a private key is its whole body.

Defined results: a null text is an empty text; null repository or owner is a value of its own; repeated rows each get a
row and count once as holders; an empty table gives an empty result; other columns are ignored. Long texts are scanned
whole, in linear time: no pattern walks a run more than a few times. A value with exactly ``copied_owners`` owners is
copied, one of exactly ``min_entropy`` bits is live; of added candidates that overlap the leftmost stays, then the one of
the kind listed first; a candidate that touches a base span is none. A private key without a body is no candidate.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_or_null, join_split, materialize

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Formats of well-known issuers, and long mixed tokens; these are the spans that the method adds.
ISSUED = re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35})")
#: A web token is found from its second part; the first one is the run before it.
TOKEN_REST = re.compile(r"\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")
TOKEN_HEAD = re.compile(r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}+")
TOKEN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
PEM = re.compile(r"-----BEGIN (?:(?!PRIVATE)[A-Z0-9]+ )*+PRIVATE KEY-----")
PEM_END = re.compile(r"-----END (?:(?!PRIVATE)[A-Z0-9]+ )*+PRIVATE KEY-----")
PEM_BODY = re.compile(r"(?:[A-Za-z0-9+/=\r\n]|\\[nr])*+")
MIXED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+")
KINDS = ("assign", "access", "hex", "issued", "pem", "mixed")
PLACEHOLDER = re.compile(r"example|sample|dummy|placeholder|changeme|xxxx|1234567|abcdef", re.I)

SCHEMA = (
    "doc_id long, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, "
    "candidates array<struct<kind:int,start:int,end:int,v1:long,v2:long,entropy:double,placeholder:boolean>>"
)


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base kinds, leftmost non-overlapping within each kind."""
    found = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def web_tokens(text: str) -> list[tuple[int, int]]:
    found, done = [], 0
    for m in TOKEN_REST.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in TOKEN_CHARS:
            start -= 1
        if head := TOKEN_HEAD.search(text, start, m.start()):
            found.append((head.start(), m.end()))
        done = m.end()
    return found


def private_keys(text: str) -> list[tuple[int, int, str]]:
    """(start, end, body): up to the end line, or without one as far as the body goes; white space is no part of the body."""
    found = []
    for m in PEM.finditer(text):
        stop = text.find("-----", m.end())
        last = PEM_END.match(text, stop) if stop >= 0 else None
        body = text[m.end() : stop] if last else PEM_BODY.match(text, m.end())[0]
        end = last.end() if last else m.end() + len(body.rstrip())
        if value := re.sub(r"\s|\\[nr]", "", body):
            found.append((m.start(), end, value))
    return found


def added_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Candidates of further kinds that no base span touches."""
    found = []
    if "_" in text or "xox" in text or "AIza" in text:
        found += [(m.start(), 3, m.end(), m[0]) for m in ISSUED.finditer(text)]
    if ".eyJ" in text:
        found += [(s, 3, e, text[s:e]) for s, e in web_tokens(text)]
    if "-----BEGIN " in text:
        found += [(s, 4, e, body) for s, e, body in private_keys(text)]
    for m in MIXED.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and v.lower() != v and v.upper() != v and entropy(v) >= 3.5:
            found.append((m.start(), 5, m.end(), v))
    taken = sorted((s, e) for s, _, e, _ in base)
    kept, i = [], 0
    for x in sorted(found):
        while i < len(taken) and taken[i][1] <= x[0]:
            i += 1
        if (i == len(taken) or taken[i][0] >= x[2]) and (not kept or kept[-1][2] <= x[0]):
            kept.append(x)
    return kept


def digest(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("v1", pa.int64()), ("v2", pa.int64()), ("entropy", pa.float64()), ("placeholder", pa.bool_())]))
    for batch in batches:
        counts, shas, all_found = [[], [], []], [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            n = Counter(k for _, k, _, _ in base)
            for k in range(3):
                counts[k].append(n[k])
            shas.append(hashlib.sha256(digest(base).encode()).hexdigest())
            all_found.append([
                {"kind": k, "start": s, "end": e, "v1": (h := xxhash.xxh3_128_intdigest(v.encode(), 7)) % (1 << 64) - (1 << 63), "v2": (h >> 64) - (1 << 63), "entropy": entropy(v), "placeholder": bool(PLACEHOLDER.search(v))}
                for s, k, e, v in base + added_spans(text, base)
            ])
        columns = [batch.column(0), batch.column(2), batch.column(3), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(all_found, kind)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "candidates"])


def scan_secrets(docs: DataFrame, repo: str = "source", owner: str = "source", copied_owners: int = 3, min_entropy: float = 3.0) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)`` with its spans, each with a verdict.

    repo, owner: the columns that name the repository and its owner. A value held by ``copied_owners`` owners or more is
    ``copied``; else one of ``min_entropy`` bits a character that is no placeholder is ``live``; else ``weak``. Base spans
    stay whatever the verdict; added spans stay if live. Columns: doc_id, n_assign, n_access, n_hex, base_sha256,
    findings (array of kind, start, end, verdict, n_repos, n_owners).
    """
    rows = docs.select(column_or_null(docs, "doc_id", "long").alias("doc_id"), column_or_null(docs, "text", "string").alias("text"), column_or_null(docs, repo, "string").alias("repo"), column_or_null(docs, owner, "string").alias("owner"))
    scanned = materialize(rows.mapInArrow(_scan, SCHEMA).withColumn("row", F.monotonically_increasing_id()), "secrets")
    hits = scanned.filter(F.size("candidates") > 0).select("row", "repo", "owner", F.inline("candidates"))
    value = ["v1", "v2"]
    # Distinct (value, owner, repo) first, combined before the shuffle: a value that a third of all rows hold is one row a task.
    holders = hits.groupBy(*value, F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repo", F.lit("\0")).alias("repo")).agg(F.count(F.lit(1)).alias("n"))
    owners = holders.groupBy(*value, "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    spread = materialize(owners.groupBy(*value).agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("copies")), "secret-spread")
    verdict = F.when(F.col("n_owners") >= copied_owners, "copied").when((F.col("entropy") >= min_entropy) & ~F.col("placeholder"), "live").otherwise("weak")
    total = spread.agg(F.sum("copies")).first()[0] or 0
    judged = join_split(hits, spread, value, total).withColumn("verdict", verdict).filter("kind < 3 or verdict = 'live'")
    finding = F.struct("start", "kind", "end", "verdict", "n_repos", "n_owners")
    by_row = judged.groupBy("row").agg(F.sort_array(F.collect_list(finding)).alias("findings"))
    names = F.array(*map(F.lit, KINDS))
    return scanned.join(by_row, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.transform(F.coalesce("findings", F.expr("cast(array() as array<struct<start:int,kind:int,end:int,verdict:string,n_repos:bigint,n_owners:bigint>>)")), lambda x: F.struct(names[x["kind"]].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["verdict"].alias("verdict"), x["n_repos"].alias("n_repos"), x["n_owners"].alias("n_owners"))).alias("findings"),
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.withColumn("repo", F.concat_ws("/", "source", "lang"))
    found = scan_secrets(docs, repo="repo", owner="source")
    text = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda v: F.size(F.filter("findings", lambda x: x["verdict"] == v)).cast("long")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), count("live").alias("n_live"), count("copied").alias("n_copied"))
