"""Queries of the code index: names, paths, scopes, call edges, line lookups, resolution, closure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detectors, lookup
from ..operators.metrics import count_per
from ..sources import readers
from .views import Queries, table, view

Q = Queries()
QUERIES, SQL = Q.functions, Q.sql


@Q.add("oob_candidates", "SELECT file_path AS file, CAST(start_line AS INT) AS line, name AS function, 'oob' AS vuln_type FROM functions WHERE coalesce(body, '') <> ''")
def oob_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.oob(view(spark, sf, "functions")).select("file", "line", "function", "vuln_type")


@Q.add("flt01_point_lookup", "SELECT function_id, name, file_path FROM functions WHERE name = 'en_fn_3'")
def point_lookup(spark, sf):
    return lookup.by_name(view(spark, sf, "functions"), "en_fn_3").select("function_id", "name", "file_path")


@Q.add("flt02_suffix_lookup", r"SELECT function_id, name, CASE WHEN name = 'EN_fn_4' THEN 0 ELSE 1 END AS tier FROM functions WHERE name = 'EN_fn_4' OR name ILIKE '%::EN\_fn\_4' ESCAPE '\'")
def suffix_lookup(spark, sf):
    return lookup.by_short_name(view(spark, sf, "functions"), "EN_fn_4").select("function_id", "name", F.when(F.col("name") == "EN_fn_4", 0).otherwise(1).alias("tier"))


TIERS = """
WITH req AS (SELECT DISTINCT concat('en_fn_', CAST(p_partkey % 100 AS STRING)) AS request FROM part UNION SELECT DISTINCT concat('Ns', CAST(p_partkey % 9 AS STRING), '::de_fn_', CAST(p_partkey % 100 AS STRING)) FROM part),
found AS (
  SELECT request, function_id, 0 AS tier FROM req JOIN functions ON name = request
  UNION ALL SELECT request, function_id, 1 FROM req JOIN functions ON name = split_part(request, '::', 2) WHERE contains(request, '::') AND (contains(signature, request) OR contains(body, request))
  UNION ALL SELECT request, function_id, 2 FROM req JOIN functions ON lower(split_part(name, '::', 2)) = lower(request) WHERE NOT contains(request, '::') AND contains(name, '::')),
best AS (SELECT request, min(tier) AS m FROM found GROUP BY request)
SELECT f.request, f.function_id, f.tier FROM found f JOIN best b ON b.request = f.request AND b.m = f.tier"""


@Q.add("flt03_tiered_names", TIERS)
def tiered_names(spark, sf):
    part = table(spark, sf, "part")
    plain = part.select(F.concat(F.lit("en_fn_"), (F.col("p_partkey") % 100).cast("string")).alias("request"))
    qualified = part.select(F.concat(F.lit("Ns"), (F.col("p_partkey") % 9).cast("string"), F.lit("::de_fn_"), (F.col("p_partkey") % 100).cast("string")).alias("request"))
    return lookup.resolve_names(plain.unionByName(qualified), view(spark, sf, "functions")).select("request", "function_id", "tier")


@Q.add("flt04_path_suffix", "WITH asked AS (SELECT DISTINCT concat(source, '/', lang, '.c') AS path FROM documents WHERE doc_id % 2 = 0 UNION SELECT DISTINCT concat('x', source, '/', lang, '.c') FROM documents) SELECT path, file_path, label FROM asked JOIN files ON file_path = path OR suffix(file_path, concat('/', path)) OR suffix(path, concat('/', file_path))")
def path_suffix(spark, sf):
    docs = table(spark, sf, "documents")
    a = docs.filter("doc_id % 2 = 0").select(F.concat("source", F.lit("\\"), "lang", F.lit(".c")).alias("path"))
    b = docs.select(F.concat(F.lit("x"), "source", F.lit("/"), "lang", F.lit(".c")).alias("path"))
    found = lookup.path_suffix_join(a.union(b).distinct(), view(spark, sf, "files"), "path", "file_path")
    return found.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), "file_path", "label")


@Q.add("flt05_like_escape", r"SELECT p_partkey, replace(replace(replace(concat(p_brand, '_100%\'), '\', '\\'), '%', '\%'), '_', '\_') AS escaped FROM part")
def like_escape(spark, sf):
    from ..functions.text import escape_like

    return table(spark, sf, "part").select("p_partkey", escape_like(F.concat("p_brand", F.lit("_100%\\"))).alias("escaped"))


@Q.add("flt06_path_scope", "SELECT function_id, file_path, start_line FROM functions WHERE file_path = 'root/src1' OR starts_with(file_path, 'root/src1/')")
def path_scope(spark, sf):
    return lookup.scoped(view(spark, sf, "functions"), "root/src1").select("function_id", "file_path", F.col("start_line").cast("long").alias("start_line"))


@Q.add("flt07_scope_or_all", "SELECT count(*) AS n FROM functions")
def scope_or_all(spark, sf):
    return lookup.scoped(view(spark, sf, "functions"), "").agg(F.count(F.lit(1)).alias("n"))


CALL_SITES = "SELECT callee_name, label, line, caller_name FROM (SELECT callee_name, caller_key, line, concat('root/src', CAST(supp % 20 AS STRING), '/en.c') AS p FROM calls WHERE callee_name = 'en_fn_7') c JOIN files ON file_path = p LEFT JOIN (SELECT doc_id AS k, concat('fn', CAST(doc_id AS STRING)) AS caller_name FROM documents WHERE doc_id % 2 = 0) d ON d.k = caller_key"


@Q.add("flt08_call_sites", CALL_SITES)
def call_sites(spark, sf):
    calls = view(spark, sf, "calls").withColumnRenamed("caller_key", "caller_id").withColumn("file_id", F.concat(F.lit("root/src"), (F.col("supp") % 20).cast("string"), F.lit("/en.c")))
    files = view(spark, sf, "files").withColumnRenamed("file_path", "file_id")
    callers = table(spark, sf, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("function_id"), F.concat(F.lit("fn"), F.col("doc_id").cast("string")).alias("name"))
    return lookup.call_sites(calls, files, callers, "en_fn_7").select("callee_name", "label", "line", "caller_name")


@Q.add("flt09_struct_by_name", "WITH f AS (SELECT function_id, name, CASE WHEN name = 'de_fn_5' THEN 0 ELSE 1 END AS tier FROM functions WHERE name = 'de_fn_5' OR suffix(name, '::de_fn_5')) SELECT function_id, name FROM f WHERE tier = (SELECT min(tier) FROM f)")
def struct_by_name(spark, sf):
    request = spark.range(1).select(F.lit("de_fn_5").alias("request"))
    return lookup.resolve_names(request, view(spark, sf, "functions")).select("function_id", "name")


@Q.add("flt10_references_by_name", "SELECT callee_name AS name, count(*) AS n, count(DISTINCT caller_key) AS callers FROM calls WHERE callee_name IN ('en_fn_1', 'Ns4::en_fn_4') GROUP BY callee_name")
def references_by_name(spark, sf):
    found = view(spark, sf, "calls").filter(F.col("callee_name").isin("en_fn_1", "Ns4::en_fn_4"))
    return found.groupBy(F.col("callee_name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("caller_key").alias("callers"))


@Q.add("flt11_first_body", "SELECT name, function_id FROM (SELECT name, function_id, row_number() OVER (PARTITION BY name ORDER BY file_path, start_line, function_id) AS n FROM functions WHERE starts_with(name, 'fr_')) WHERE n = 1")
def first_body(spark, sf):
    functions = view(spark, sf, "functions")
    return lookup.first_body(functions, functions.filter(F.col("name").startswith("fr_"))).select("name", "function_id")


@Q.add("flt12_in_list", "SELECT finding_id, scan_id FROM findings WHERE finding_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def in_list(spark, sf):
    wanted = table(spark, sf, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("finding_id"))
    return view(spark, sf, "findings").join(wanted, "finding_id", "left_semi").select("finding_id", "scan_id")


@Q.add("flt16_paths_under_root", "SELECT function_id, substr(file_path, 6) AS path FROM functions WHERE starts_with(file_path, 'root/')")
def paths_under_root(spark, sf):
    found = view(spark, sf, "functions").withColumn("path", readers.relative_path(F.concat(F.lit("/work/"), "file_path"), "/work/root"))
    return found.filter("path IS NOT NULL").select("function_id", "path")


@Q.add("src01_skipped_dirs", "SELECT page_id, regexp_matches(url, '/(vendor|build|out|deps|external)/') OR regexp_matches(url, '^[^/]*//\\.git/') AS skipped, regexp_matches(lower(url), '\\.(c|cc|cpp|cxx|h|hh|hpp|hxx)$') AS is_source FROM pages")
def skipped_dirs(spark, sf):
    return table(spark, sf, "pages").select("page_id", readers.in_skipped_dir(F.col("url")).alias("skipped"), readers.has_suffix(F.col("url")).alias("is_source"))


@Q.add("src05_text_lines", "SELECT doc_id, pos AS line, s[pos] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)")
def text_lines(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text")
    return readers.text_lines(docs).select(F.col("path").alias("doc_id"), F.col("line").cast("long").alias("line"), "text")


@Q.add("src10_cut_text", "SELECT doc_id, length(CASE WHEN length(text) > 16000 THEN concat(substr(text, 1, 16000), chr(10), '... [diff truncated]') ELSE text END) AS n FROM documents")
def cut_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(readers.cut_diff(F.col("text"))).cast("long").alias("n"))


@Q.add("src12_scan_with_path", "SELECT f.function_id, f.file_path, l.label, f.start_line FROM functions f JOIN files l ON l.file_path = f.file_path")
def scan_with_path(spark, sf):
    found = lookup.with_files(view(spark, sf, "functions"), lookup.small(view(spark, sf, "files")), "file_path")
    return found.orderBy("file_path", "start_line").select("function_id", "file_path", "label", F.col("start_line").cast("long").alias("start_line"))


STABBING = """
WITH req AS (SELECT doc_id AS request_id, concat('root/', source, '/', lang, '.c') AS path, n_chars * 3 + doc_id AS line FROM documents),
hits AS (SELECT request_id, function_id, row_number() OVER (PARTITION BY request_id ORDER BY end_line - start_line, file_path, start_line, function_id) AS n FROM req JOIN functions ON file_path = path AND line BETWEEN start_line AND end_line)
SELECT request_id, function_id FROM hits WHERE n = 1"""


def _requests(spark, sf, root="root/"):
    docs = table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("request_id"), F.concat(F.lit(root), "source", F.lit("/"), "lang", F.lit(".c")).alias("path"), (F.col("n_chars") * 3 + F.col("doc_id")).alias("line"))


@Q.add("jon04_containing_function", STABBING)
def containing_function(spark, sf):
    return lookup.containing_function(_requests(spark, sf), view(spark, sf, "functions")).select("request_id", "function_id")


@Q.add("jon05_containing_function_suffix", STABBING.replace("'root/', source", "'root/', source"))
def containing_function_suffix(spark, sf):
    return lookup.containing_function(_requests(spark, sf, "/build/root/"), view(spark, sf, "functions"), by_suffix=True).select("request_id", "function_id")


RESOLVE = """
WITH full_ AS (SELECT name, count(*) AS n, min(function_id) AS id FROM functions GROUP BY name),
short_ AS (SELECT CASE WHEN contains(name, '::') THEN split_part(name, '::', 2) ELSE name END AS s, count(*) AS n, min(function_id) AS id FROM functions GROUP BY 1)
SELECT caller_key, line, part, supp, c.callee_name, CASE WHEN f.n IS NOT NULL THEN CASE WHEN f.n = 1 THEN f.id END WHEN s.n = 1 THEN s.id END AS callee_function_id
FROM calls c LEFT JOIN full_ f ON f.name = c.callee_name LEFT JOIN short_ s ON s.s = CASE WHEN contains(c.callee_name, '::') THEN split_part(c.callee_name, '::', 2) ELSE c.callee_name END"""


@Q.add("jon06_resolve_calls", RESOLVE)
def resolve_calls(spark, sf):
    return lookup.resolve_calls(view(spark, sf, "calls"), view(spark, sf, "functions")).select("caller_key", "line", "part", "supp", "callee_name", "callee_function_id")


GLOBALS = """
WITH vars AS (SELECT p_brand AS name, p_partkey AS global_id, p_size % 20 AS file_id, p_partkey % 3 = 0 AS is_static FROM part),
refs AS (SELECT l_orderkey * 100000000 + l_partkey * 1000 + l_suppkey * 10 + l_linenumber AS ref_id, concat('Brand#', CAST(l_suppkey % 60 AS STRING)) AS name, l_linenumber AS file_id FROM lineitem)
SELECT ref_id, coalesce((SELECT min(v.global_id) FROM vars v WHERE v.name = refs.name AND v.file_id = refs.file_id AND v.is_static), (SELECT min(v.global_id) FROM vars v WHERE v.name = refs.name AND NOT v.is_static), (SELECT min(v.global_id) FROM vars v WHERE v.name = refs.name)) AS global_id FROM refs"""


@Q.add("jon07_resolve_globals", GLOBALS)
def resolve_globals(spark, sf):
    variables = table(spark, sf, "part").selectExpr("p_brand AS name", "p_partkey AS global_id", "p_size % 20 AS file_id", "p_partkey % 3 = 0 AS is_static")
    refs = table(spark, sf, "lineitem").selectExpr("l_orderkey * 100000000 + l_partkey * 1000 + l_suppkey * 10 + l_linenumber AS ref_id", "concat('Brand#', l_suppkey % 60) AS name", "l_linenumber AS file_id")
    return lookup.resolve_globals(refs, variables).select("ref_id", "global_id")


@Q.add("agg01_index_counts", "SELECT 'functions' AS relation, count(*) AS n FROM functions UNION ALL SELECT 'files', count(*) FROM files UNION ALL SELECT 'calls', count(*) FROM calls")
def index_counts(spark, sf):
    parts = [view(spark, sf, v).agg(F.count(F.lit(1)).alias("n")).select(F.lit(v).alias("relation"), "n") for v in ("functions", "files", "calls")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


CLOSURE = """
WITH fns AS (SELECT DISTINCT p_partkey AS k FROM part WHERE p_partkey % 5 <> 0),
edges AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS r FROM lineitem WHERE l_quantity > 40),
lits AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity < 2),
names AS (SELECT k FROM fns UNION SELECT r FROM edges),
s0 AS (SELECT n.k, CASE WHEN n.k IN (5, 10) THEN TRUE WHEN n.k IN (7, 20) THEN FALSE WHEN f.k IS NULL THEN TRUE WHEN l.k IS NOT NULL THEN TRUE ELSE FALSE END AS c FROM names n LEFT JOIN fns f ON f.k = n.k LEFT JOIN lits l ON l.k = n.k),
s1 AS (SELECT s.k, CASE WHEN s.k IN (5, 10, 7, 20) THEN s.c ELSE s.c OR s.k IN (SELECT e.k FROM edges e JOIN s0 x ON x.k = e.r WHERE x.c) END AS c FROM s0 s),
s2 AS (SELECT s.k, CASE WHEN s.k IN (5, 10, 7, 20) THEN s.c ELSE s.c OR s.k IN (SELECT e.k FROM edges e JOIN s1 x ON x.k = e.r WHERE x.c) END AS c FROM s1 s)
SELECT k AS name, c AS can_return_null FROM s2"""


@Q.add("npd_funcret_closure", CLOSURE)
def null_closure(spark, sf):
    functions = table(spark, sf, "part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("name"))
    items = table(spark, sf, "lineitem")
    returns = items.filter("l_quantity > 40").select(F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("returned")).unionByName(items.filter("l_quantity < 2").select(F.col("l_partkey").alias("name"), F.lit(None).cast("long").alias("returned")))
    return lookup.reachable_null_returners(functions, returns, [5, 10], [7, 20])


@Q.add("jon02_callers_left", "SELECT o_orderkey, o_custkey, count(l_orderkey) AS n FROM orders LEFT JOIN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) l ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey")
def callers_left(spark, sf):
    calls = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return count_per(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), calls, "o_orderkey")
