"""Readers: all of them are Spark sources with filters on paths or columns; no file is opened by the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normal_path, truncated
from ..operators.candidates import keep_first

#: Folders that hold no source of the project, and prefixes of such folders.
SKIPPED_DIRS = (
    ".audit-index",
    ".git",
    ".svn",
    ".hg",
    "node_modules",
    "vendor",
    "third_party",
    "3rdparty",
    "thirdparty",
    "external",
    "extern",
    "deps",
    "build",
    "cmake-build-debug",
    "cmake-build-release",
    "out",
    "output",
    "_build",
    ".build",
    "__pycache__",
    ".venv",
    "venv",
)
SKIPPED_PREFIXES = (".audit-index-",)
C_SUFFIXES = ("c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx")


def in_skipped_dir(path: Column, dirs=SKIPPED_DIRS, prefixes=SKIPPED_PREFIXES) -> Column:
    """Whether a folder of the relative path is skipped; its last part is the file."""
    parts = F.split(normal_path(path), "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 1))
    by_prefix = F.exists(folders, lambda d: F.array_contains(F.array(*[F.startswith(d, F.lit(p)) for p in prefixes]), True)) if prefixes else F.lit(False)
    return F.arrays_overlap(folders, F.array(*map(F.lit, dirs))) | by_prefix


def has_suffix(path: Column, suffixes=C_SUFFIXES) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(suffixes) + ")$")


def relative_path(path: Column, root: str) -> Column:
    """The path below root, from a path or a file URL; null if it is not below it."""
    root = root.rstrip("/") + "/"
    plain = F.regexp_replace(normal_path(path), "^file:/+", "/")
    return F.when(plain.startswith(root), F.substring(plain, len(root) + 1, 1 << 20)).when(~plain.startswith("/"), plain)


def source_files(spark: SparkSession, root: str, suffixes=C_SUFFIXES, dirs=SKIPPED_DIRS, prefixes=SKIPPED_PREFIXES) -> DataFrame:
    """Rows ``(path, text)`` of the source files below root: names first, so that skipped files are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = relative_path(F.col("path"), root)
    kept = files.withColumn("rel", rel).filter(has_suffix(F.col("rel"), suffixes) & ~in_skipped_dir(F.col("rel"), dirs, prefixes))
    # Bytes that are no UTF-8 become replacement characters.
    return kept.select(F.col("rel").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def text_lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("text", "\r\n|[\n\r\f\x0b\x1c\x1d\x1e\x85  ]")).alias("_at", "text")).select("path", (F.col("_at") + 1).alias("line"), "text")


TAG = "_type string, name string, path string, line long, end long, kind string, signature string, scope string, typeref string, extras string"


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a tagger's JSON lines; other types and broken lines are dropped."""
    return spark.read.schema(TAG).option("mode", "DROPMALFORMED").json(path).filter(F.col("_type") == "tag")


MATCHES = "results array<struct<path:string,check_id:string,start:struct<line:int>,extra:struct<severity:string,message:string,lines:string,metavars:map<string,struct<abstract_content:string>>,metadata:map<string,string>>>>"


def read_matches(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Matches of a pattern matcher's JSON output, numbered in order of file and place; a document a file, or a line."""
    rows = spark.read.schema(MATCHES).option("multiLine", str(multi_line).lower()).json(path).select(F.col("_metadata.file_path").alias("file"), F.posexplode("results").alias("at", "m"))
    metavars = F.transform_values("m.extra.metavars", lambda _, v: v["abstract_content"])
    number = F.concat_ws("#", "file", F.lpad(F.col("at").cast("string"), 9, "0"))
    shown = F.when(F.col("m.extra.lines").contains("requires login"), "").otherwise(F.col("m.extra.lines"))
    return rows.select(number.alias("match_id"), normal_path(F.col("m.path")).alias("path"), F.col("m.start.line").alias("line"), "m.check_id", F.coalesce("m.extra.severity", F.lit("WARNING")).alias("severity"), "m.extra.message", shown.alias("lines"), F.coalesce(metavars, F.create_map().cast("map<string,string>")).alias("metavars"), F.col("m.extra.metadata").alias("metadata"))


def read_leak_errors(spark: SparkSession, path: str) -> DataFrame:
    """Errors of an external checker's XML output, with their first location."""
    schema = "_id string, _severity string, _msg string, location array<struct<_file:string,_line:int>>"
    rows = spark.read.format("xml").option("rowTag", "error").schema(schema).load(path)
    rows = rows.filter(F.coalesce("_id", F.lit("")) != "")
    return rows.select(F.col("_id").alias("id"), F.col("_severity").alias("severity"), F.col("_msg").alias("message"), F.get("location", F.lit(0))["_file"].alias("file"), F.get("location", F.lit(0))["_line"].alias("line"))


def read_git_log(spark: SparkSession, path: str, limit: int = 200, since: str | None = None, paths: list[str] | None = None) -> DataFrame:
    """``(commit, subject)`` of a log, newest first as in the file, at most ``limit`` (0 for all).

    A line is the commit, a unit separator and the subject; where since or paths are asked for, the commit's time and its
    changed paths (joined by tabs) stand between them. since: only commits of that time or later. paths: only commits that
    change one of them or something below it. A line without a commit or separator is dropped. Files are read in parts, their
    lines in the order of file, part and line; a limit keeps the first ones of each task.
    """
    filtered = since is not None or bool(paths)
    # Lines of a part of a file are read in order by one task, so their numbers rise; the part's offset orders the parts.
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    parts = F.split("line", "\x1f", 4 if filtered else 2)
    rows = lines.filter(F.col("line").contains("\x1f")).select("file", "offset", "at", F.trim(parts[0]).alias("commit"), F.trim(F.element_at(parts, -1)).alias("subject"), F.get(parts, F.lit(1)).alias("date"), F.split(F.coalesce(F.get(parts, F.lit(2)), F.lit("")), "\t").alias("changed"))
    rows = rows.filter("commit <> ''")
    if since is not None:
        rows = rows.filter(F.try_to_timestamp("date") >= F.to_timestamp(F.lit(since)))
    if paths:
        under = [p.strip("/") for p in paths]
        rows = rows.filter(F.exists("changed", lambda c: F.array_contains(F.array(*[(c == p) | c.startswith(p + "/") for p in under]), True)))
    rows = rows.orderBy("file", "offset", "at")
    return (rows.limit(limit) if limit else rows).select("commit", "subject")


def cut_diff(diff: Column, limit: int = 16_000) -> Column:
    return truncated(diff, limit, "\n... [diff truncated]")


def read_artifacts(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """JSON documents below root named by ``paths(key, path)``; a path that leaves the root stops the job."""
    bad = paths.filter(F.col("path").startswith("/") | F.arrays_overlap(F.split("path", "/"), F.array(F.lit("..")))).take(1)
    if bad:
        raise ValueError(f"path outside the artifacts: {bad[0]['path']}")
    docs = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(relative_path(F.col("_metadata.file_path"), root).alias("path"), F.col("value").alias("json"))
    return paths.join(docs, "path")


MANIFEST = "name string, label string, family string, description string, enabled boolean, user_created boolean"


def flat_yaml(text: Column, key: str) -> Column:
    """The scalar of a top-level key of a YAML document: plain, quoted, or a block of indented lines; null without it."""
    line = F.regexp_extract(text, rf"(?m)^{key}:[ \t]*([^\r\n]*)", 1)
    block = F.regexp_extract(text, rf"(?m)^{key}:[ \t]*[|>][+-]?[ \t]*\r?\n((?:(?:[ \t]+[^\r\n]*)?(?:\r?\n|$))+)", 1)
    quoted = F.when(line.rlike(r'^"(?:[^"\\]|\\.)*"'), F.regexp_replace(F.regexp_extract(line, r'^"((?:[^"\\]|\\.)*)"', 1), r'\\(["\\])', "$1")).when(line.rlike(r"^'(?:[^']|'')*'"), F.replace(F.regexp_extract(line, r"^'((?:[^']|'')*)'", 1), F.lit("''"), F.lit("'")))
    plain = F.trim(F.regexp_replace(line, r"(?:^|[ \t])#.*$", ""))
    folded = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(block, r"(?m)^[ \t]+", ""), r"\s+$", ""), r"\r?\n", F.when(line.startswith(">"), F.lit(" ")).otherwise(F.lit("\n"))))
    value = F.when(line.rlike(r"^[|>][+-]?[ \t]*$"), folded).otherwise(F.coalesce(quoted, plain))
    return F.when(~value.isin("", "~", "null"), value)


def read_manifests(spark: SparkSession, root: str, name: str = "checker.{yaml,yml,json}") -> DataFrame:
    """Enabled rule manifests in YAML or JSON; of several with a name the first by path stays. A manifest without a name is
    named by its folder; one without ``enabled`` is enabled."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    parsed = F.from_json("text", MANIFEST)
    is_json = F.lower("path").endswith(".json")
    truth = lambda c: F.when(F.lower(c).isin("true", "yes", "on"), True).when(F.lower(c).isin("false", "no", "off"), False)
    fields = [(f.split()[0], f.split()[1]) for f in MANIFEST.split(", ")]
    value = lambda f, kind: F.when(is_json, parsed[f]).otherwise(truth(flat_yaml(F.col("text"), f)) if kind == "boolean" else flat_yaml(F.col("text"), f))
    rows = files.select("path", *[value(f, kind).alias(f) for f, kind in fields])
    folder = F.element_at(F.split("path", "/"), -2)
    rows = rows.withColumn("name", F.coalesce(F.nullif(F.trim("name"), F.lit("")), folder)).filter(F.coalesce("enabled", F.lit(True)))
    return keep_first(rows, ["name"], ["path"])


def catalog(agents: DataFrame, column: str = "products") -> DataFrame:
    """Distinct trimmed names of a JSON list a row, ignoring case; the first spelling by agent stays; sorted."""
    names = agents.select("agent", F.posexplode(F.from_json(column, "array<string>")).alias("at", "name")).withColumn("name", F.trim("name")).filter("name <> ''")
    return keep_first(names.withColumn("_k", F.lower("name")), ["_k"], ["agent", "at"]).select("name").orderBy("name")
