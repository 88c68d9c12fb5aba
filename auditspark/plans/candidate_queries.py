"""Queries of the candidate algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates as C
from ..operators import results as R
from ..schemas import CANDIDATE_KEY
from ..sources.versions import read_stored, upsert_stored
from .views import Queries, scratch, table, view

Q = Queries()
QUERIES, SQL = Q.functions, Q.sql
KEY = list(CANDIDATE_KEY)


@Q.add("win01_keep_first", "SELECT file, line, function, vuln_type, seq FROM (SELECT *, row_number() OVER (PARTITION BY file, line, function, vuln_type ORDER BY seq) AS n FROM candidates) WHERE n = 1")
def keep_first(spark, sf):
    return C.keep_first(view(spark, sf, "candidates"), KEY, ["seq"]).select(*KEY, "seq")


@Q.add("win02_keep_first_other_key", "SELECT file, line, family, seq FROM (SELECT *, row_number() OVER (PARTITION BY file, line, family ORDER BY seq, function, vuln_type) AS n FROM candidates) WHERE n = 1")
def keep_first_other_key(spark, sf):
    return C.keep_first(view(spark, sf, "candidates"), ["file", "line", "family"], ["seq", "function", "vuln_type"]).select("file", "line", "family", "seq")


@Q.add("opt_family_merge", "SELECT family, file, function, min(seq) AS first_seq, count(DISTINCT seq) AS merged FROM candidates GROUP BY family, file, function")
def family_merge(spark, sf):
    found = C.merge_families(view(spark, sf, "candidates"), ["seq"])
    return found.select("family", "file", "function", F.col("seq").alias("first_seq"), F.size("merged_from").cast("long").alias("merged"))


@Q.add("jon08_resume_anti_join", "SELECT file, line, function, vuln_type, seq FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM candidates p WHERE p.quantity > 30 AND p.file = c.file AND p.line = c.line AND p.function = c.function AND p.vuln_type = c.vuln_type)")
def resume(spark, sf):
    rows = view(spark, sf, "candidates")
    return C.without_processed(rows, rows.filter("quantity > 30").select(*KEY)).select(*KEY, "seq")


#: Candidates with more than 20 units are processed; of those whose key is no multiple of 4 the result may be retried. Some
#: retries have no stored candidate (their rows are left out of what is stored), some candidates are placeholders.
CONTINUABLE = """
WITH c AS (SELECT *, CASE WHEN seq % 9 = 0 THEN ' Threat_Audit' ELSE vuln_type END AS kind FROM candidates WHERE l_orderkey % 10 <> 0 OR quantity <= 20),
all_ AS (SELECT file, line, function, CASE WHEN seq % 9 = 0 THEN ' Threat_Audit' ELSE vuln_type END AS kind, seq, l_orderkey, quantity FROM candidates),
s AS (SELECT * FROM c WHERE lower(trim(kind)) <> 'threat_audit'),
p AS (SELECT DISTINCT file, line, function, kind FROM all_ WHERE quantity > 20),
open_ AS (SELECT file, line, function, kind, min(seq) AS seq FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.file = s.file AND p.line = s.line AND p.function = s.function AND p.kind = s.kind) GROUP BY ALL),
r AS (SELECT file, line, function, kind, min(seq) AS seq FROM all_ WHERE quantity > 20 AND l_orderkey % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM open_ o WHERE o.file = all_.file AND o.line = all_.line AND o.function = all_.function AND o.kind = all_.kind) GROUP BY ALL),
last_ AS (SELECT file, line, function, kind, max(seq) AS seq FROM s GROUP BY ALL)
SELECT file, line, function, kind AS vuln_type, seq FROM open_ UNION ALL SELECT r.file, r.line, r.function, r.kind, coalesce(l.seq, r.seq) FROM r LEFT JOIN last_ l ON l.file = r.file AND l.line = r.line AND l.function = r.function AND l.kind = r.kind"""


def _continuable(spark, sf):
    rows = view(spark, sf, "candidates").withColumn("vuln_type", F.when(F.col("seq") % 9 == 0, " Threat_Audit").otherwise(F.col("vuln_type")))
    processed = rows.filter("quantity > 20")
    return C.continuable(rows.filter("l_orderkey % 10 <> 0 OR quantity <= 20"), processed.select(*KEY), processed.filter("l_orderkey % 4 <> 0").select(*KEY, "seq"))


@Q.add("jon09_continuable", CONTINUABLE)
def continuable(spark, sf):
    return _continuable(spark, sf).select(*KEY, "seq")


@Q.add("set07_preferred_union", f"SELECT vuln_type, count(*) AS n, CAST(sum(seq) AS BIGINT) AS total FROM ({CONTINUABLE}) GROUP BY vuln_type")
def preferred_union(spark, sf):
    return _continuable(spark, sf).groupBy("vuln_type").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("total"))


@Q.add("flt14_retryable", "SELECT finding_id, coalesce(ai_verdict, '') IN ('timeout', 'error', 'failed', 'cancelled', '') AS retryable FROM findings")
def retryable(spark, sf):
    return view(spark, sf, "findings").select("finding_id", C.retryable(F.col("ai_verdict")).alias("retryable"))


SUPPRESSED = """
WITH c AS (SELECT *, quantity = 50 AS rejected FROM candidates), f AS (SELECT {key}, min(seq) AS first FROM c WHERE rejected GROUP BY {key})
SELECT c.file, c.line, c.function, c.vuln_type, c.seq, coalesce(c.seq > f.first, FALSE) AS suppressed FROM c LEFT JOIN f ON {on}"""


def _suppressed(spark, sf, scope):
    rows = view(spark, sf, "candidates")
    return C.suppressed(rows, C.pattern_of(scope), F.col("quantity") == 50).select(*KEY, "seq", "suppressed")


@Q.add("win08_suppress_function", SUPPRESSED.format(key="vuln_type, function", on="c.vuln_type = f.vuln_type AND c.function = f.function"))
def suppress_function(spark, sf):
    return _suppressed(spark, sf, "directory")


@Q.add("win08_suppress_file", SUPPRESSED.format(key="vuln_type, file", on="c.vuln_type = f.vuln_type AND c.file = f.file"))
def suppress_file(spark, sf):
    return _suppressed(spark, sf, "file")


@Q.add("win08_suppress_project", SUPPRESSED.format(key="vuln_type", on="c.vuln_type = f.vuln_type"))
def suppress_project(spark, sf):
    return _suppressed(spark, sf, "project")


@Q.add("agg28_rejects_pattern", "SELECT l_orderkey AS file, bool_and(l_returnflag <> 'A' AND l_linestatus = 'O') AS rejects FROM lineitem GROUP BY l_orderkey")
def rejects_pattern(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), (F.col("l_returnflag") == "A").alias("confirmed"), F.when(F.col("l_linestatus") == "O", "not_confirmed").otherwise("confirmed").alias("ai_verdict"))
    return C.rejects_pattern(rows, ["file"])


@Q.add("win05_dense_index", "SELECT finding_id, scan_id, idx FROM findings")
def dense_index(spark, sf):
    rows = view(spark, sf, "findings").drop("idx")
    return C.dense_index(rows, ["scan_id"], ["finding_id"]).select("finding_id", "scan_id", F.col("idx").cast("long").alias("idx"))


@Q.add("agg04_next_index", "SELECT scan_id, coalesce(max(idx), -1) + 1 AS next_idx FROM findings GROUP BY scan_id")
def next_index(spark, sf):
    return C.next_index(view(spark, sf, "findings"), ["scan_id"]).select("scan_id", F.col("next_idx").cast("long").alias("next_idx"))


@Q.add("snk04_upsert", "SELECT k, max_by(v, s) AS v FROM (SELECT c_custkey AS k, CAST(c_acctbal AS DOUBLE) AS v, -1 AS s FROM customer UNION ALL SELECT o_custkey, CAST(o_totalprice AS DOUBLE), o_orderkey FROM orders) GROUP BY k")
def upsert(spark, sf):
    path = scratch(spark, "upsert")
    stored = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(-1).cast("long").alias("seq"))
    changes = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("seq"))
    upsert_stored(stored, path, ["k"], change_id="base")
    # The second of these does nothing.
    for _ in range(2):
        upsert_stored(changes, path, ["k"], change_id="orders")
    return read_stored(spark, path).select("k", "v")


@Q.add("snk05_insert_or_ignore", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def insert_or_ignore(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").dropDuplicates()


@Q.add("win07_merge_in_place", "SELECT user_id, event_type, min(event_id) AS place, max(event_id) AS latest, max_by(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def merge_in_place(spark, sf):
    found = C.merge_in_place(table(spark, sf, "events"), ["user_id", "event_type"], "event_id")
    return found.select("user_id", "event_type", "place", F.col("event_id").alias("latest"), "value")


@Q.add("win11_keep_earliest", "SELECT l_partkey, l_suppkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def keep_earliest(spark, sf):
    return C.keep_first(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_partkey", "l_suppkey", "l_orderkey")


@Q.add("agg25_duplicated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicated_keys(spark, sf):
    return C.duplicated_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


ROUTES = """
WITH r AS (SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity > 20 END AS yes, CASE l_returnflag WHEN 'A' THEN 'alloc' WHEN 'R' THEN 'free' ELSE 'other' END AS role FROM lineitem WHERE l_partkey % 4 <> 0),
last_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, role, coalesce(CAST(yes AS INT), -1)) AS n FROM r) WHERE n = 1)
SELECT p_partkey AS candidate_id, CASE WHEN yes IS NULL THEN 'unresolved' WHEN NOT yes THEN 'rejected' WHEN role = 'alloc' THEN 'allocator' WHEN role = 'free' THEN 'deallocator' ELSE 'unresolved' END AS outcome
FROM part LEFT JOIN last_ ON id = p_partkey"""


@Q.add("jon21_route_results", ROUTES)
def route_results(spark, sf):
    items = table(spark, sf, "lineitem").filter("l_partkey % 4 <> 0")
    role = F.when(F.col("l_returnflag") == "A", "alloc").when(F.col("l_returnflag") == "R", "free").otherwise("other")
    results = items.select(F.col("l_partkey").alias("candidate_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_quantity") <= 45, F.col("l_quantity") > 20).alias("is_memory_api"), role.alias("role"))
    # Equal numbers are put in a fixed order first.
    results = C.keep_first(results, ["candidate_id", "seq"], ["role", F.coalesce(F.col("is_memory_api").cast("int"), F.lit(-1))])
    return C.route_results(table(spark, sf, "part").select(F.col("p_partkey").alias("candidate_id")), results).select("candidate_id", "outcome")


@Q.add("lim03_batches", "SELECT o_orderkey, o_custkey, CAST(floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / 8) AS BIGINT) AS batch FROM orders")
def fixed_batches(spark, sf):
    return C.batches(table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"], 8).select("o_orderkey", "o_custkey", "batch")


@Q.add("set01_concatenate", "SELECT 'a' AS src, c_custkey AS id, c_mktsegment AS extra FROM customer UNION ALL SELECT 'b', s_suppkey, NULL FROM supplier")
def concatenate(spark, sf):
    a = table(spark, sf, "customer").select(F.lit("a").alias("src"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("extra"))
    b = table(spark, sf, "supplier").select(F.lit("b").alias("src"), F.col("s_suppkey").alias("id"))
    return C.concatenate([a, b])


@Q.add("set02_union_names", "SELECT p_brand AS name FROM part UNION SELECT c_mktsegment FROM customer UNION SELECT s_name FROM supplier")
def union_names(spark, sf):
    parts = [table(spark, sf, name).select(F.col(column).alias("name")) for name, column in (("part", "p_brand"), ("customer", "c_mktsegment"), ("supplier", "s_name"))]
    return R.union_of_names(parts)


@Q.add("set03_intersection", "SELECT DISTINCT l_orderkey AS function_id FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def intersection(spark, sf):
    names = table(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.concat(F.lit("alloc_"), F.col("s_suppkey").cast("string")).alias("name"))
    call = F.concat(F.lit("p = alloc_"), F.col("l_suppkey").cast("string"), F.lit(" (n);"))
    functions = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("function_id")).agg(F.array_join(F.collect_set(call), "\n").alias("body"))
    return R.calling_any(functions, names).select("function_id")


@Q.add("set04_difference", "SELECT l_partkey AS name FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1 EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 2 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def difference(spark, sf):
    rows = table(spark, sf, "lineitem")
    name = F.col("l_partkey").alias("name")
    return C.difference(rows.filter("l_returnflag = 'A' AND l_linenumber = 1").select(name), rows.filter("l_returnflag = 'R' AND l_linenumber = 2").select(name), rows.filter("l_quantity > 49").select(name))


@Q.add("set05_unknown_names", "SELECT DISTINCT l_partkey AS name FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")
def unknown_names(spark, sf):
    known = table(spark, sf, "part").filter("p_size < 40").select(F.col("p_partkey").alias("name"))
    return C.unknown_names(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("name")), known)


@Q.add("jon22_task_findings", "SELECT c_custkey AS task, coalesce(string_agg(CAST(o_orderkey AS STRING), ',' ORDER BY o_orderkey), '') AS findings FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY c_custkey")
def task_findings(spark, sf):
    findings = table(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("source_task_id"), F.col("o_orderkey").alias("idx"))
    found = R.findings_of_tasks(table(spark, sf, "customer").select(F.col("c_custkey").alias("task_id")), findings)
    return found.select(F.col("task_id").alias("task"), F.array_join(F.col("finding_ids").cast("array<string>"), ",").alias("findings"))


@Q.add("prj01_normalise_finding", "SELECT finding_id, greatest(1, CAST(idx AS BIGINT)) AS line, coalesce(nullif(ai_verdict, ''), CASE WHEN confirmed THEN 'confirmed' ELSE 'not_confirmed' END) AS ai_verdict, CASE WHEN finding_id % 4 = 0 THEN 'unknown' ELSE severity END AS severity FROM findings")
def normalise_finding(spark, sf):
    rows = view(spark, sf, "findings").withColumns({"line": F.col("idx"), "severity": F.when(F.col("finding_id") % 4 != 0, F.col("severity")).otherwise(" ")})
    return R.normalised(rows).select("finding_id", "line", "ai_verdict", "severity")


@Q.add("prj02_fallback_rows", "SELECT c.l_orderkey, c.l_linenumber, CASE WHEN o_orderkey IS NULL THEN 'failed' WHEN o_orderstatus = 'P' THEN 'timeout' ELSE 'ok' END AS verdict FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) c LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 4 <> 0) o ON o_orderkey = c.l_orderkey")
def fallback_rows(spark, sf):
    results = table(spark, sf, "orders").filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return R.with_fallback(rows, results, ["l_orderkey"], F.col("o_orderstatus") == "P").select("l_orderkey", "l_linenumber", F.col("outcome").alias("verdict"))


@Q.add("prj04_stable_id", "SELECT o_orderkey, substr(sha1(concat(CAST(o_custkey AS STRING), chr(0), CAST(o_orderkey AS STRING))), 1, 20) AS id FROM orders")
def stable_id(spark, sf):
    from ..functions.text import stable_id as ident

    return table(spark, sf, "orders").select("o_orderkey", ident(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("id"))


@Q.add("prj07_names_and_short_names", "SELECT name FROM functions UNION SELECT CASE WHEN contains(name, '::') THEN split_part(name, '::', 2) ELSE name END FROM functions")
def names_and_short_names(spark, sf):
    from ..functions.text import short_name

    return view(spark, sf, "functions").select(F.explode(F.array("name", short_name(F.col("name")))).alias("name")).distinct()


@Q.add("agg18_runs_per_checker", "SELECT vuln_type, count(*) AS n FROM candidates GROUP BY vuln_type")
def runs_per_checker(spark, sf):
    from ..operators.detectors import runs_per_checker as per

    return per(view(spark, sf, "candidates"))
