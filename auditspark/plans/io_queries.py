"""Queries of readers, sinks and streams: files are written from the driver's tables to a scratch folder and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json_text as J
from ..sources import readers as R
from ..sources import writers as W
from ..streaming import ordered as O
from ..streaming import progress as P
from .views import Queries, scratch, table, view

Q = Queries()
QUERIES, SQL = Q.functions, Q.sql

FOLDERS = [*R.SKIPPED_DIRS, ".audit-index-3", "src", "builds", "Vendor", ".github", "my.git", "outer", "node", "lib"]
_LIST = ", ".join(f"'{f}'" for f in FOLDERS)
_SKIPPED = ", ".join(f"'{f}'" for f in R.SKIPPED_DIRS)
SUFFIXES = ["a.c", "b.cc", "c.cpp", "d.cxx", "e.h", "f.hh", "g.hpp", "h.hxx", "i.C", "j.cs", "k.c.txt", "hpp", "l.java"]
_FILES = ", ".join(f"'{f}'" for f in SUFFIXES)


@Q.add("src02_skipped_names", f"SELECT p_partkey, list_contains([{_SKIPPED}], f) OR starts_with(f, '.audit-index-') AS skipped FROM (SELECT p_partkey, list_extract([{_LIST}], CAST(p_partkey % {len(FOLDERS)} + 1 AS INT)) AS f FROM part)")
def skipped_names(spark, sf):
    folder = F.element_at(F.array(*map(F.lit, FOLDERS)), (F.col("p_partkey") % len(FOLDERS) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", R.in_skipped_dir(F.concat(F.lit("a/"), folder, F.lit("/vendor.c"))).alias("skipped"))


@Q.add("src04_source_suffixes", rf"SELECT p_partkey, f FROM (SELECT p_partkey, list_extract([{_FILES}], CAST(p_partkey % {len(SUFFIXES)} + 1 AS INT)) AS f FROM part) WHERE regexp_matches(lower(f), '\.(c|cc|cpp|cxx|h|hh|hpp|hxx)$')")
def source_suffixes(spark, sf):
    name = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("p_partkey") % len(SUFFIXES) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", name.alias("f")).filter(R.has_suffix(F.col("f")))


@Q.add("src06_tags", "SELECT c_name AS name, c_custkey AS line, CASE WHEN c_custkey % 2 = 0 THEN c_custkey + 5 END AS \"end\", c_mktsegment AS kind FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 7 <> 0")
def tags(spark, sf):
    path, key = scratch(spark, "tags"), F.col("c_custkey")
    entry = F.to_json(F.struct(F.when(key % 3 == 0, "ptag").otherwise("tag").alias("_type"), F.col("c_name").alias("name"), F.lit("a.c").alias("path"), key.alias("line"), F.when(key % 2 == 0, key + 5).alias("end"), F.col("c_mktsegment").alias("kind")))
    table(spark, sf, "customer").select(F.when(key % 7 == 0, F.concat(F.lit("{broken "), entry)).otherwise(entry).alias("value")).write.text(path)
    return R.read_tags(spark, path).select("name", "line", "end", "kind")


@Q.add("src07_matches", "SELECT concat('src/', s_name) AS path, CAST(s_suppkey + i AS INT) AS line, CASE WHEN s_suppkey % 2 = 0 THEN 'ERROR' ELSE 'WARNING' END AS severity, CASE WHEN i = 0 THEN '' ELSE 'x = y;' END AS lines, CASE WHEN s_suppkey % 3 > 0 THEN concat('p', CAST(s_suppkey AS STRING)) END AS p FROM supplier CROSS JOIN (VALUES (0), (1)) AS t(i)")
def matches(spark, sf):
    path, key = scratch(spark, "matches"), F.col("s_suppkey")
    metavars = F.when(key % 3 > 0, F.create_map(F.lit("$P"), F.struct(F.concat(F.lit("p"), key.cast("string")).alias("abstract_content"))))
    extra = lambda shown: F.struct(F.when(key % 2 == 0, "ERROR").alias("severity"), F.lit("m").alias("message"), F.lit(shown).alias("lines"), metavars.alias("metavars"))
    one = lambda i, shown: F.struct(F.concat(F.lit("src\\"), "s_name").alias("path"), F.lit("r.x").alias("check_id"), F.struct((key + i).alias("line")).alias("start"), extra(shown).alias("extra"))
    table(spark, sf, "supplier").select(F.to_json(F.struct(F.array(one(0, "requires login"), one(1, "x = y;")).alias("results"))).alias("value")).write.text(path)
    return R.read_matches(spark, path, multi_line=False).select("path", "line", "severity", "lines", F.col("metavars")["$P"].alias("p"))


@Q.add("src08_leak_errors", "SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'memleak' ELSE 'style' END AS id, concat('Memory <', s_name, '> & more') AS message, CASE WHEN s_suppkey % 5 <> 0 THEN concat(s_name, '.c') END AS file, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey AS INT) END AS line FROM supplier")
def leak_errors(spark, sf):
    path, key = scratch(spark, "errors"), F.col("s_suppkey")
    place = F.when(key % 5 != 0, F.concat(F.lit('<location file="'), "s_name", F.lit('.c" line="'), key.cast("string"), F.lit('"/><location file="other.c" line="1"/>'))).otherwise("")
    element = F.concat(F.lit('<error id="'), F.when(key % 2 == 0, "memleak").otherwise("style"), F.lit('" severity="error" msg="Memory &lt;'), "s_name", F.lit('&gt; &amp; more">'), place, F.lit("</error>"))
    # One document a nation.
    documents = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(element), "\n").alias("all"))
    documents.select("s_nationkey", F.concat(F.lit('<?xml version="1.0"?>\n<results version="2"><errors>'), "all", F.lit("</errors></results>")).alias("value")).write.partitionBy("s_nationkey").text(path)
    return R.read_leak_errors(spark, path).select("id", "message", "file", "line")


@Q.add("src09_git_log", "SELECT concat('c', CAST(o_orderkey AS VARCHAR)) AS commit, concat('fix ', o_orderpriority) AS subject FROM orders WHERE o_orderkey % 6 <> 0 AND o_custkey % 5 <> 2 AND o_orderdate >= TIMESTAMP '1994-01-06' ORDER BY o_orderkey LIMIT 200")
def git_log(spark, sf):
    path, key = scratch(spark, "log"), F.col("o_orderkey")
    changed = F.when(F.col("o_custkey") % 5 == 2, "docs/a.md\tlibs/x.c").otherwise("docs/a.md\tlib/x.c")
    line = F.when(key % 6 == 0, F.lit("no separator")).otherwise(F.concat(F.lit("c"), key.cast("string"), F.lit("\x1f"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("\x1f"), changed, F.lit("\x1ffix "), "o_orderpriority"))
    # A log in order over several files, whose names are in order too.
    table(spark, sf, "orders").repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").select(line.alias("value")).write.text(path)
    return R.read_git_log(spark, path, 200, since="1994-01-06", paths=["lib/"])


@Q.add("src11_manifests", "SELECT concat('rule', CAST(n_nationkey % 10 AS STRING)) AS name, concat('it''s \"', n_name, '\"') AS label, concat('first ', n_name, chr(10), 'second') AS description, n_regionkey = 1 AS user_created FROM (SELECT *, row_number() OVER (PARTITION BY n_nationkey % 10 ORDER BY n_nationkey) AS k FROM nation WHERE n_regionkey <> 3) WHERE k = 1")
def manifests(spark, sf):
    path, key = scratch(spark, "manifests"), F.col("n_nationkey")
    text = F.concat(F.lit("# rule\nname: rule"), (key % 10).cast("string"), F.lit("  # comment\nlabel: 'it''s \""), "n_name", F.lit("\"'\ndescription: |\n  first "), "n_name", F.lit("\n  second\nenabled: "), F.when(F.col("n_regionkey") == 3, "no").otherwise("true"), F.lit("\nuser_created: "), (F.col("n_regionkey") == 1).cast("string"), F.lit("\nnested:\n  name: other\n"))
    # One file a nation, in a folder of its own.
    table(spark, sf, "nation").select(F.lpad(key.cast("string"), 2, "0").alias("folder"), text.alias("value")).write.partitionBy("folder").text(path)
    return R.read_manifests(spark, path, "*.txt").select("name", "label", "description", "user_created")


@Q.add("src13_artifacts", "SELECT concat('{\"n\":\"', n_name, '\"}') AS json FROM nation")
def artifacts(spark, sf):
    path = scratch(spark, "artifacts")
    table(spark, sf, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("n"))).alias("value")).write.partitionBy("n_nationkey").text(path)
    root = path.removeprefix("file://")
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(R.relative_path(F.col("path"), root).alias("path")).withColumn("key", F.col("path"))
    return R.read_artifacts(spark, root, paths).select(F.trim(F.regexp_replace("json", "\n", "")).alias("json"))


@Q.add("snk01_append", "SELECT c_custkey, c_name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def append(spark, sf):
    path = scratch(spark, "append")
    W.append_rows(table(spark, sf, "customer").select("c_custkey", "c_name"), path)
    W.append_rows(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name")), path)
    return spark.read.parquet(path)


@Q.add("snk02_index", "SELECT p_partkey, p_name, TRUE AS complete, FALSE AS other FROM part WHERE p_size > 10")
def index(spark, sf):
    path = scratch(spark, "index")
    W.write_index({"files": table(spark, sf, "nation"), "functions": table(spark, sf, "part").select("p_partkey", "p_name")}, path, "v1")
    W.write_index({"functions": table(spark, sf, "part").filter("p_size > 10").select("p_partkey", "p_name")}, path, "v2")
    return spark.read.parquet(f"{path}/functions").withColumns({"complete": F.lit(W.index_complete(spark, path, "v2")), "other": F.lit(W.index_complete(spark, path, "v1"))})


@Q.add("snk03_replace_scan", "SELECT o_custkey AS scan_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx FROM orders WHERE o_custkey % 3 <> 0 OR o_orderstatus = 'F' AND o_custkey % 2 = 0")
def replace_scan(spark, sf):
    path = scratch(spark, "findings")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("scan_id"), "o_orderkey", "o_orderstatus")
    W.replace_scan(rows, path, ["o_orderkey"])
    # Every third scan is run again: half of them find less, the others nothing.
    again = rows.filter("scan_id % 3 = 0")
    W.replace_scan(again.filter("o_orderstatus = 'F' AND scan_id % 2 = 0"), path, ["o_orderkey"], again.select("scan_id"))
    return spark.read.parquet(path).select("scan_id", "o_orderkey", F.col("idx").cast("long").alias("idx"))


@Q.add("snk07_json_array", "WITH x AS (SELECT c_custkey, c_name, c_custkey = max(c_custkey) OVER () AS last FROM customer) SELECT concat('  {', chr(10), '    \"name\": \"', c_name, ' é\\\"\", ', chr(10), '    \"line\": ', CAST(c_custkey AS STRING), ',', chr(10), '    \"note\": null', chr(10), '  }', CASE WHEN last THEN '' ELSE ',' END) AS value FROM x UNION ALL SELECT unnest(['[', ']'])".replace("\", ', chr(10)", "\",', chr(10)"))
def json_array(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("seq"), F.concat("c_name", F.lit(' é"')).alias("name"), F.col("c_custkey").alias("line"), F.lit(None).cast("string").alias("note"))
    return W.candidates_json(rows)


#: An event's own JSON, {"k": number}, as it is and changed in ways that a schema must tell.
JSON = "CASE event_id % 10 WHEN 0 THEN props WHEN 1 THEN regexp_replace(props, '([0-9]+)', '\"$1\"') WHEN 2 THEN replace(props, '}', ', \"x\": 1}') WHEN 3 THEN '{}' WHEN 4 THEN replace(props, '}', ', \"l\": []}') WHEN 5 THEN replace(props, '}', ', \"l\": [\"a\"]}') WHEN 6 THEN replace(props, '}', ', \"l\": [\"a\", \"b\", \"c\"]}') WHEN 7 THEN regexp_replace(props, '[0-9]+', 'true') WHEN 8 THEN concat('[', props, ']') ELSE replace(props, '}', '') END"


@Q.add("jsn03_schema", "SELECT event_id, event_id % 10 IN (0, 5) AND CAST(regexp_extract(props, '[0-9]+') AS INT) BETWEEN 1 AND 50 AS fits FROM events")
def schema(spark, sf):
    rule = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"allOf": [{"type": "integer"}, {"enum": list(range(1, 51))}]}, "l": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "string"}}}}
    return table(spark, sf, "events").select("event_id", F.expr(JSON).alias("js")).select("event_id", J.fits_schema(F.col("js"), rule).alias("fits"))


@Q.add("st05_stream_suppression", "SELECT c.seq, c.l_orderkey, coalesce(c.seq > f.first, FALSE) AS suppressed FROM candidates c LEFT JOIN (SELECT vuln_type, function, min(seq) AS first FROM candidates WHERE quantity = 50 GROUP BY vuln_type, function) f ON f.vuln_type = c.vuln_type AND f.function = c.function")
def stream_suppression(spark, sf):
    rows = view(spark, sf, "candidates").select(F.concat_ws("\0", "vuln_type", "function").alias("pattern"), in_order("seq").alias("at"), "seq", (F.col("quantity") == 50).alias("rejected"))
    found = streamed(spark, rows, "pattern", "at", O.stream_suppression)
    return found.select("seq", F.substring_index(F.col("pattern"), "fn", -1).cast("long").alias("l_orderkey"), "suppressed")


def in_order(number):
    """Times in the order of numbers, a day after the epoch and on: a stream's first watermark is the epoch."""
    return F.timestamp_micros(F.col(number) + F.lit(86_400_000_000))


def streamed(spark, rows, key, at, stream, mode="append"):
    """What a stream makes of the rows, with the batch that each came from. A last row, of a key that sorts after all others
    and a day later than they, moves the watermark past all of them; its own key is left out."""
    source, target = scratch(spark, "stream"), scratch(spark, "streamed")
    late = rows.agg((F.max(at) + F.expr("INTERVAL 1 DAY")).alias("end")).first().end
    rows.write.parquet(source)
    last, none = {key: "~", at: late}, {"bigint": 0, "string": "", "boolean": False}
    end = spark.range(1).select(*(F.lit(last.get(c, none.get(kind))).cast(kind).alias(c) for c, kind in rows.dtypes))
    end.write.mode("append").parquet(source)
    written = stream(spark.readStream.schema(rows.schema).parquet(source)).filter(F.col(key) != "~")

    def write(batch, number):
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{target}/{number:08d}")

    written.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", True).schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in written.schema.fields)}, batch long").parquet(target)


RANK = "CASE WHEN phase IN ('analyzing', 'static_analysis') THEN 1 WHEN phase = 'auditing' THEN 2 WHEN phase IN ('completed', 'error', 'cancelled') THEN 3 ELSE 0 END"


@Q.add("st02_stream_states", f"SELECT CAST(scan_id AS VARCHAR) AS scan_id, CASE max(r) WHEN 3 THEN min_by(phase, seq) FILTER (WHERE r = 3) WHEN 2 THEN 'auditing' WHEN 1 THEN 'analyzing' ELSE 'pending' END AS status, bool_or(r >= 2) AS static_done, count(*) AS n_events, max_by(message, seq) AS last_message FROM (SELECT *, {RANK} AS r FROM scan_events) GROUP BY scan_id")
def stream_states(spark, sf):
    rows = view(spark, sf, "scan_events").select(F.col("scan_id").cast("string").alias("scan_id"), in_order("seq").alias("ts"), "seq", "phase", "message")
    found = streamed(spark, rows, "scan_id", "ts", O.stream_states)
    last = found.groupBy("scan_id").agg(F.max_by(F.struct("status", "static_done", "n_events", "last_message"), "n_events").alias("s"))
    return last.select("scan_id", "s.*")


@Q.add("st12_stream_offline", "WITH s AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events), gap AS (SELECT *, CASE WHEN next IS NULL OR epoch_us(next) - epoch_us(ts) >= 3600000000 THEN epoch_us(ts) + 3600000000 END AS gone FROM s) SELECT event_id, min(gone) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ended_micros FROM gap QUALIFY event_type = 'purchase'")
def stream_offline(spark, sf):
    bought = F.col("event_type") == "purchase"
    rows = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("agent"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.when(bought, F.col("event_id").cast("string")).alias("scan_id"), F.when(bought, "auditing").alias("status"))
    found = streamed(spark, rows, "agent", "at", lambda stream: O.stream_offline(stream, timeout_seconds=3600))
    return found.filter("status = 'cancelled'").select(F.col("scan_id").cast("long").alias("event_id"), F.unix_micros("at").alias("ended_micros"))


@Q.add("win10_stream_last_events", "SELECT CAST(scan_id AS VARCHAR) AS scan_id, seq, CAST(n AS INT) AS place, phase FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY ts DESC, seq DESC) AS n FROM scan_events) WHERE n <= 20")
def stream_last_events(spark, sf):
    rows = view(spark, sf, "scan_events").select(F.col("scan_id").cast("string").alias("scan_id"), F.col("ts").cast("timestamp").alias("ts"), "seq", "phase")
    found = streamed(spark, rows, "scan_id", "ts", lambda stream: O.stream_last_events(stream, values=("phase",), n=20), "update")
    # The ring of the last batch in which a scan had events.
    last = found.groupBy("scan_id").agg(F.max("batch").alias("batch"))
    return found.join(last, ["scan_id", "batch"]).select("scan_id", "seq", "place", "phase")


@Q.add("st09_fan_out", "SELECT consumer, scan_id, seq, phase, batch FROM scan_events CROSS JOIN (VALUES ('list', CAST(0 AS BIGINT)), ('detail', CAST(0 AS BIGINT))) AS t(consumer, batch)")
def fan_out(spark, sf):
    source, checkpoint = scratch(spark, "events"), scratch(spark, "checkpoint")
    rows = view(spark, sf, "scan_events").select("scan_id", "seq", "phase")
    rows.write.parquet(source)
    folders = {name: scratch(spark, name) for name in ("list", "detail")}
    for writer in P.fan_out(spark.readStream.schema(rows.schema).parquet(source), folders, checkpoint):
        writer.trigger(availableNow=True).start().awaitTermination()
    read = [spark.read.parquet(path).select(F.lit(name).alias("consumer"), "scan_id", "seq", "phase") for name, path in folders.items()]
    return read[0].unionByName(read[1]).join(F.broadcast(P.consumer_progress(spark, checkpoint, list(folders))), "consumer")


@Q.add("st09_keepalives", "WITH s AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) SELECT CAST(user_id AS VARCHAR) AS consumer, count(*) AS events, CAST(coalesce(sum(CASE WHEN next IS NOT NULL THEN (epoch_us(next) - epoch_us(ts)) // 1800000000 - CASE WHEN (epoch_us(next) - epoch_us(ts)) % 1800000000 = 0 AND epoch_us(next) > epoch_us(ts) THEN 1 ELSE 0 END END), 0) AS BIGINT) AS keepalives FROM s GROUP BY user_id")
def keepalives(spark, sf):
    """Keepalives of half an hour between a consumer's first and last event."""
    rows = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("consumer"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload"))
    found = streamed(spark, rows, "consumer", "at", lambda stream: O.stream_with_keepalives(stream, seconds=1800))
    last = found.filter("kind = 'event'").groupBy("consumer").agg(F.max("sent_at").alias("last"))
    own = found.join(last, "consumer").filter("sent_at <= last")
    return own.groupBy("consumer").agg(F.count_if(F.col("kind") == "event").alias("events"), F.count_if(F.col("kind") == "keepalive").alias("keepalives"))
