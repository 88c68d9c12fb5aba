"""Queries of the string, array and JSON functions, and of the text detectors over the driver's texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json_text as J
from ..functions import text as T
from ..operators import detectors as D
from ..operators import results as R
from ..operators.joins import WIDE_ROWS, dealt
from .views import Queries, table, view

Q = Queries()
QUERIES, SQL = Q.functions, Q.sql


def over(spark, sf, sql, name):
    """The rows of the SQL over one table of the driver."""
    table(spark, sf, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def docs(spark, sf):
    return table(spark, sf, "documents")


@Q.add("str01_short_name", "SELECT function_id, CASE WHEN contains(name, '::') THEN split_part(name, '::', 2) ELSE name END AS short FROM functions")
def short_name(spark, sf):
    return view(spark, sf, "functions").select("function_id", T.short_name(F.col("name")).alias("short"))


@Q.add("str02_qualified_name", "SELECT function_id, CASE WHEN trim(source) <> '' AND NOT contains(name, '::') THEN concat(source, '::', name) ELSE name END AS q FROM functions")
def qualified_name(spark, sf):
    return view(spark, sf, "functions").select("function_id", T.qualified_name(F.col("name"), F.col("source")).alias("q"))


@Q.add("str03_return_type", "SELECT page_id, CASE WHEN contains(url, ':') THEN substr(url, strpos(url, ':') + 1) ELSE url END AS rest FROM pages")
def return_type(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.return_type(F.col("url")).alias("rest"))


@Q.add("str04_slice_lines", "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS part FROM documents")
def slice_lines(spark, sf):
    return docs(spark, sf).select("doc_id", T.slice_lines(F.col("text"), F.lit(2), F.lit(4)).alias("part"))


@Q.add("str06_statement_end", "SELECT doc_id, coalesce(list_min(list_filter(list_transform(range(1, len(string_split(text, chr(10))) + 1), lambda i: CASE WHEN contains(string_split(text, chr(10))[i], ';') AND i >= 2 THEN i END), lambda x: x IS NOT NULL)), 2) AS line FROM (SELECT doc_id, replace(text, '. ', '; ') AS text FROM documents)")
def statement_end(spark, sf):
    return docs(spark, sf).select("doc_id", T.statement_end(F.replace("text", F.lit(". "), F.lit("; ")), F.lit(2)).cast("long").alias("line"))


@Q.add("str07_access_type", r"SELECT doc_id, CASE WHEN regexp_matches(text, '\btoken\s*(\[.*?\]\s*)?([-+*/%&|^]?=|\+\+|--)') OR regexp_matches(text, '(\+\+|--)\s*\btoken\b') THEN 'write' ELSE 'read' END AS access FROM documents")
def access_type(spark, sf):
    return docs(spark, sf).select("doc_id", T.access_type(F.lit("token"), F.col("text")).alias("access"))


CODE = "SELECT doc_id, concat('int f(T *p', CAST(doc_id % 4 AS STRING), ') { if (!p', CAST(doc_id % 3 AS STRING), ') return 1; return p', CAST(doc_id % 4 AS STRING), '->a->b[2]->c; }') AS code, concat('p', CAST(doc_id % 4 AS STRING)) AS v FROM documents"


def code(spark, sf):
    return over(spark, sf, CODE, "documents")


@Q.add("str08_null_guard", f"SELECT doc_id, contains(code, concat('if (!', v, ')')) AS guarded FROM ({CODE})")
def null_guard(spark, sf):
    return code(spark, sf).select("doc_id", T.null_guarded(F.col("code"), F.col("v")).alias("guarded"))


@Q.add("str10_normal_expression", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\s*->\s*', '->', 'g'), '\s*\[\s*', '[', 'g'), '\s*\]\s*', ']', 'g'), '\s+', ' ', 'g') AS e FROM (SELECT doc_id, trim(replace(replace(text, ', ', ' -> '), '. ', ' [ 1 ] ')) AS t FROM documents)")
def normal_expression(spark, sf):
    text = F.replace(F.replace("text", F.lit(", "), F.lit(" -> ")), F.lit(". "), F.lit(" [ 1 ] "))
    return docs(spark, sf).select("doc_id", T.normal_expression(text).alias("e"))


@Q.add("str11_first_matching_line", "SELECT doc_id, coalesce(list_min(list_filter(list_transform(range(1, len(string_split(text, chr(10))) + 1), lambda i: CASE WHEN regexp_matches(string_split(text, chr(10))[i], 'token|Licensed') THEN i + 99 END), lambda x: x IS NOT NULL)), 100) AS line FROM documents")
def first_matching_line(spark, sf):
    return docs(spark, sf).select("doc_id", T.first_matching_line(F.col("text"), F.lit("token|Licensed"), F.lit(100)).cast("long").alias("line"))


@Q.add("str12_keyword_boundary", "SELECT function_id, regexp_matches(name, '(^|_|::)fn(_|$)') AS hit FROM (SELECT function_id, replace(name, '::', '_') AS name FROM functions)")
def keyword_boundary(spark, sf):
    return view(spark, sf, "functions").select("function_id", T.keyword_at_boundary(F.replace("name", F.lit("::"), F.lit("_")), "fn").alias("hit"))


@Q.add("str13_terms", "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(lower(text), '[^a-z0-9 ]+', '', 'g'), 'password|secret|license|token|key'))), ',') AS terms FROM documents")
def terms(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(T.terms_in(F.col("text"), ["key", "token", "secret", "password", "license"]), ",").alias("terms"))


@Q.add("str14_call_names", r"SELECT doc_id, array_to_string(regexp_extract_all(code, '\b([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1), ',') AS calls FROM (" + CODE + ")")
def call_names(spark, sf):
    return code(spark, sf).select("doc_id", F.array_join(T.call_names(F.col("code")), ",").alias("calls"))


ROLE = "SELECT o_orderkey, concat(CASE o_orderkey % 3 WHEN 0 THEN 'xmalloc' WHEN 1 THEN 'node_free' ELSE 'visit' END, CAST(o_orderkey AS STRING)) AS name, CASE o_orderkey % 4 WHEN 0 THEN 'p = malloc (8);' WHEN 1 THEN 'free(p);' ELSE 'go();' END AS body FROM orders"


@Q.add("str15_role_hint", f"SELECT o_orderkey, CASE WHEN a AND NOT f THEN 'alloc' WHEN f AND NOT a THEN 'free' ELSE 'unknown' END AS role FROM (SELECT o_orderkey, contains(name, 'malloc') OR contains(body, 'malloc') AS a, contains(name, 'free') OR contains(body, 'free') AS f FROM ({ROLE}))")
def role_hint(spark, sf):
    rows = over(spark, sf, ROLE, "orders")
    return rows.select("o_orderkey", T.role_hint(F.col("name"), F.col("body")).alias("role"))


PAIRS = "SELECT p_partkey, concat('pool', CAST(p_partkey % 50 AS STRING), CASE p_partkey % 2 WHEN 0 THEN '_alloc' ELSE '_create' END) AS a, concat('pool', CAST(p_partkey % 80 AS STRING), CASE p_partkey % 2 WHEN 0 THEN '_free' ELSE '_destroy' END) AS f FROM part"


@Q.add("jon18_name_pairs", f"WITH x AS ({PAIRS}), fr AS (SELECT split_part(f, '_', 1) AS k, max_by(f, p_partkey) AS free_name FROM x GROUP BY 1) SELECT DISTINCT a AS alloc_name, free_name FROM x JOIN fr ON k = split_part(a, '_', 1)")
def name_pairs(spark, sf):
    rows = over(spark, sf, PAIRS, "part")
    return D.name_pairs(rows.select(F.col("a").alias("name")), rows.select(F.col("f").alias("name"), F.col("p_partkey").alias("seq")))


@Q.add("str17_pair_name", f"SELECT p_partkey, split_part(a, '_', 1) AS an, split_part(f, '_', 1) AS fn FROM ({PAIRS})")
def pair_name(spark, sf):
    rows = over(spark, sf, PAIRS, "part")
    return rows.select("p_partkey", T.pair_name(F.col("a"), "alloc").alias("an"), T.pair_name(F.col("f"), "free").alias("fn"))


@Q.add("str18_wrapper_allocators", f"SELECT DISTINCT name FROM ({ROLE}) WHERE contains(body, 'malloc') AND NOT contains(name, 'free')")
def wrapper_allocators(spark, sf):
    rows = over(spark, sf, ROLE, "orders")
    return D.wrapper_allocators(rows, ["malloc", "calloc"], ["free"])


LOCKED = "SELECT o_orderkey AS function_id, concat('fn', CAST(o_orderkey AS STRING)) AS name, 'a.c' AS file_path, o_custkey AS start_line, concat(CASE WHEN o_orderkey % 2 = 0 THEN 'pthread_mutex_lock (m); ' ELSE '' END, CASE WHEN o_orderkey % 3 = 0 THEN 'if (x) return 1; ' ELSE '' END, CASE WHEN o_orderkey % 5 = 0 THEN 'pthread_mutex_unlock(m); ' ELSE '' END, 'return 0;') AS body FROM orders"


@Q.add("str19_lock_leaks", f"SELECT name AS function, start_line AS line, CASE WHEN contains(body, 'unlock') THEN 'mutex_lock' ELSE 'mutex_lock (never released)' END AS held FROM ({LOCKED}) WHERE contains(body, 'mutex_lock') AND contains(body, 'return 1')")
def lock_leaks(spark, sf):
    rows = over(spark, sf, LOCKED, "orders")
    return D.lock_leaks(rows).select("function", F.col("line").cast("long").alias("line"), F.col("metadata")["subject"].alias("held"))


@Q.add("str20_safe_filename", r"SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'unnamed') AS name FROM pages")
def safe_filename(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.safe_filename(F.col("url")).alias("name"))


@Q.add("str21_merge_text", "SELECT c_custkey, CASE WHEN b = '' OR contains(a, b) THEN a WHEN a = '' OR contains(b, a) THEN b ELSE concat(a, chr(10), b) END AS t FROM (SELECT c_custkey, trim(c_name) AS a, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN '' ELSE substr(c_name, 1, 4) END AS b FROM customer)")
def merge_text(spark, sf):
    b = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, "").otherwise(F.substring("c_name", 1, 4))
    return table(spark, sf, "customer").select("c_custkey", T.merge_text(F.col("c_name"), b).alias("t"))


@Q.add("str22_folded", r"SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) AS k FROM documents")
def folded(spark, sf):
    return docs(spark, sf).select("doc_id", T.folded(F.col("text")).alias("k"))


@Q.add("str23_generated_ids", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN concat('module ', CAST(c_custkey AS STRING)) WHEN 1 THEN concat('module ', CAST(c_custkey AS STRING)) WHEN 2 THEN c_name ELSE concat('node view ', CAST(c_custkey AS STRING)) END AS label FROM customer")
def generated_ids(spark, sf):
    m, key = F.col("c_custkey") % 4, F.col("c_custkey").cast("string")
    name = F.when(m == 0, F.concat(F.lit(" Node-"), key)).when(m == 1, " ").when(m == 2, F.concat(F.col("c_name"), F.lit(" "))).otherwise(F.concat(F.lit("node view "), key))
    return table(spark, sf, "customer").select("c_custkey", R.label_or_id(name, F.col("c_custkey")).alias("label"))


@Q.add("str25_preview", r"SELECT doc_id, CASE WHEN length(t) > 50 THEN concat(substr(t, 1, 50), '... (', CAST(length(t) - 50 AS STRING), ' more)') ELSE t END AS p FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)")
def preview(spark, sf):
    return docs(spark, sf).select("doc_id", T.preview(F.col("text"), 50).alias("p"))


@Q.add("str26_fence", "SELECT o_orderkey, repeat(chr(96), greatest(3, CAST(o_orderkey % 6 AS INT) + 1)) AS fence FROM orders")
def fence(spark, sf):
    text = F.concat(F.lit("a ` b "), F.expr("repeat('`', CAST(o_orderkey % 6 AS INT))"), F.lit(" c"))
    rows = table(spark, sf, "orders")
    return rows.select("o_orderkey", F.when(F.col("o_orderkey") % 6 == 0, T.fence(F.lit("none"))).otherwise(T.fence(text)).alias("fence"))


@Q.add("mth01_bounded_int", "SELECT event_id, CASE WHEN TRY_CAST(x AS INT) IS NULL THEN 7 ELSE greatest(0, least(20, TRY_CAST(x AS INT))) END AS n FROM (SELECT event_id, json_extract_string(props, '$.k') AS x FROM events)")
def bounded_int(spark, sf):
    return table(spark, sf, "events").select("event_id", T.bounded_int(F.get_json_object("props", "$.k"), 0, 20, 7).alias("n"))


@Q.add("mth02_progress", "SELECT o_custkey, CASE WHEN count(*) FILTER (WHERE o_orderstatus <> 'O') = 0 THEN NULL ELSE round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) FILTER (WHERE o_orderstatus <> 'O'), 4) END AS progress FROM orders GROUP BY o_custkey")
def progress(spark, sf):
    done, total = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") != "O")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.try_divide(done, total), 4).alias("progress"))


@Q.add("arr01_ordered_distinct", "SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations WHERE role IS NOT NULL GROUP BY conv_id, role) GROUP BY conv_id")
def ordered_distinct(spark, sf):
    rows = table(spark, sf, "conversations").filter("role IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("all"))
    return rows.select("conv_id", F.array_join(F.array_distinct(F.transform("all", lambda x: x["role"])), ",").alias("roles"))


@Q.add("lim02_capped_evidence", "SELECT l_orderkey, array_to_string(list_slice(list_sort(list(DISTINCT l_partkey)), 1, 3), ',') AS parts FROM lineitem GROUP BY l_orderkey")
def capped_evidence(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(R.capped(F.col("l_partkey"), 3).cast("array<string>"), ",").alias("parts"))


@Q.add("jsn06_encode", "SELECT c_custkey, concat('{\"id\":', CAST(c_custkey AS STRING), ',\"name\":', CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE concat('\"', c_name, ' é\"') END, '}') AS js FROM customer")
def encode(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 != 0, F.concat("c_name", F.lit(" é"))).alias("name"))
    return rows.select("c_custkey", R.encoded(["id", "name"]).alias("js"))


@Q.add("jsn07_signature", "SELECT c_custkey, sha256(concat('{\"id\":', CAST(c_custkey AS STRING), ',\"name\":\"', c_name, '\"}')) AS signature FROM customer")
def signature(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", J.signature(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))).alias("signature"))


@Q.add("jsn01_embedded_json", "SELECT event_id, props AS raw FROM events")
def embedded_json(spark, sf):
    text = F.concat(F.lit("answer {broken "), "props", F.lit(" done ] }"))
    return table(spark, sf, "events").select("event_id", F.explode(J.all_json(text)).alias("j")).select("event_id", F.col("j.raw").alias("raw"))


@Q.add("flt13_optional_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 AND o_custkey < 50")
def optional_filters(spark, sf):
    return R.where_all(table(spark, sf, "orders"), [F.col("o_orderstatus") == "F", None, F.col("o_totalprice") >= 100000, F.col("o_custkey") < 50]).select("o_orderkey")


STATIC = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN ' Threat_Audit ' WHEN 1 THEN NULL ELSE o_orderstatus END AS vuln_type, CASE o_custkey % 4 WHEN 0 THEN 'THREAT_ANALYSIS ' WHEN 1 THEN 'index' END AS source FROM orders"


@Q.add("flt15_static_candidates", f"SELECT o_orderkey FROM ({STATIC}) WHERE coalesce(lower(trim(vuln_type)), '') <> 'threat_audit' AND coalesce(lower(trim(source)), '') <> 'threat_analysis'")
def static_candidates(spark, sf):
    rows = over(spark, sf, STATIC, "orders").withColumn("metadata", F.create_map(F.lit("source"), F.col("source")))
    return R.static_candidates(rows).select("o_orderkey")


@Q.add("flt17_visible", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 OR s_nationkey = 3")
def visible(spark, sf):
    rules = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") > 0).alias("public"), F.col("s_nationkey").alias("owner"))
    return R.visible(rules, F.lit(3), admin=False).select("s_suppkey")


@Q.add("flt19_list_filters", "SELECT finding_id FROM findings WHERE severity = 'O' AND vuln_type = '2-HIGH' AND coalesce(user_verdict, 'pending') = 'pending'")
def list_filters(spark, sf):
    return R.listed(view(spark, sf, "findings"), severity="O", vuln_type="2-HIGH", verdict="pending").select("finding_id")


@Q.add("prj03_audit_status", "SELECT finding_id, CASE WHEN ai_verdict = 'timeout' THEN 'timeout' WHEN coalesce(ai_verdict, '') = '' THEN 'waiting' WHEN ai_verdict = 'confirmed' THEN 'issue' ELSE 'clean' END AS status FROM findings")
def audit_status(spark, sf):
    return view(spark, sf, "findings").select("finding_id", R.audit_status(F.col("ai_verdict")).alias("status"))


CAPTURED = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE l_partkey % 6 WHEN 0 THEN 'r.int-mul' WHEN 1 THEN 'r.sub-header' WHEN 2 THEN 'r.add' ELSE 'r.other' END AS source, CASE WHEN l_partkey % 5 = 0 THEN concat('q', CAST(l_linenumber AS STRING), ' << 2') END AS arith, CASE WHEN l_suppkey % 3 > 0 THEN 'a' END AS a, CASE WHEN l_suppkey % 4 > 0 THEN ' b ' END AS b, CASE WHEN l_orderkey % 3 = 0 THEN 'n' ELSE '' END AS n, CASE WHEN l_orderkey % 7 = 0 THEN 'off' END AS off FROM lineitem"
OPERATED = "CASE WHEN contains(source, 'sub') THEN '-' WHEN contains(source, 'add') THEN '+' WHEN contains(source, 'mul') THEN '*' ELSE '+/-/*' END"


def captured(spark, sf):
    rows = over(spark, sf, CAPTURED, "lineitem")
    names = {"ARITH": "arith", "A": "a", "B": "b", "COUNT": "n", "SIZE": "off", "LEN": "n", "OFF": "off", "CALL": "off", "ARR": "a", "IDX": "n", "PTR": "b", "BOUND": "source"}
    return rows.withColumn("metavars", F.create_map(*[x for k, v in names.items() for x in (F.lit(f"${k}"), F.col(v))]))


@Q.add("prj05_best_expression", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(arith, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN concat('a ', {OPERATED}, ' b') END, CASE WHEN n = 'n' AND off = 'off' THEN 'n * off' END) AS e, coalesce(CASE WHEN off = 'off' THEN 'off(...)' END, CASE WHEN a IS NOT NULL AND (n = 'n' OR arith IS NOT NULL) THEN concat('a[', coalesce(nullif(n, ''), arith), ']') END, CASE WHEN b IS NOT NULL AND arith IS NOT NULL THEN concat('*(b +/- ', arith, ')') END, concat('loop bound ', source)) AS sink FROM ({CAPTURED})")
def best_expression(spark, sf):
    return captured(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R.arithmetic(F.col("source")).alias("e"), R.sink().alias("sink"))


@Q.add("prj06_file_counts", "SELECT c_custkey, CASE WHEN c_nationkey > 0 THEN c_nationkey END AS files FROM customer")
def file_counts(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", R.real_count(F.col("c_nationkey")).alias("files"))


@Q.add("jon01_entity_files", "SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def entity_files(spark, sf):
    from ..operators.lookup import small, with_files

    nation = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return with_files(table(spark, sf, "customer"), small(nation), "c_nationkey").select("c_custkey", "n_name")


@Q.add("jon03_references", "SELECT l_orderkey, l_linenumber, l_partkey, s_name, o_orderstatus FROM lineitem JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 2 = 0) o ON o_orderkey = l_orderkey")
def references(spark, sf):
    functions = table(spark, sf, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("function_id"), F.col("o_orderstatus").alias("name"))
    files = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("file_id"), "s_name")
    rows = table(spark, sf, "lineitem").withColumns({"function_id": F.col("l_orderkey"), "file_id": F.col("l_suppkey")})
    return R.references_of(rows, files, functions).select("l_orderkey", "l_linenumber", "l_partkey", "s_name", F.col("function_name").alias("o_orderstatus"))


@Q.add("jon15_scans_users", "SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) n ON n_nationkey = c_nationkey")
def scans_users(spark, sf):
    users = table(spark, sf, "nation").filter("n_regionkey <> 1").select(F.col("n_nationkey").alias("user_id"), F.col("n_name").alias("username"))
    return R.scans_with_users(table(spark, sf, "customer").withColumn("user_id", F.col("c_nationkey")), users).select("c_custkey", F.col("username").alias("n_name"))


TASKS = """
WITH path AS (SELECT o_custkey AS scan, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderpriority, o_orderstatus, o_custkey % 90 AS r1, o_orderkey % 70 AS r2 FROM orders),
named AS (SELECT *, concat('tree-', CAST(scan % 3 + 1 AS STRING)) AS tree_id, CASE WHEN o_orderkey % 3 = 0 THEN concat('tree-', CAST(scan % 3 + 1 AS STRING), '-path-', CAST(pos + 1 AS STRING)) ELSE concat('P', CAST(o_orderkey AS STRING)) END AS path_id FROM path),
pattern AS (SELECT named.*, i, CASE WHEN i = 0 THEN concat(path_id, '-pattern-1') ELSE concat('T', o_orderstatus) END AS pattern_id, CASE WHEN i = 0 THEN 'unnamed pattern' ELSE o_orderpriority END AS method_name FROM named CROSS JOIN (VALUES (0), (1), (2)) AS t(i) WHERE i < 2),
module AS (SELECT DISTINCT s_suppkey % 60 AS m FROM supplier)
SELECT CAST(scan AS STRING) AS scan_id, substr(sha1(concat(CAST(scan AS STRING), chr(0), tree_id, chr(0), path_id, chr(0), pattern_id, chr(0), method_name)), 1, 20) AS task_id, pattern_id, concat('m', CAST(r1 AS STRING)) AS surface_name,
 coalesce('src/m' || CAST(a.m % 13 AS STRING), 'src/m' || CAST(b.m % 13 AS STRING), '') AS code_path,
 CASE WHEN a.m IS NULL AND b.m IS NULL THEN 'unnamed risk' WHEN a.m IS NULL THEN concat('risk', CAST(b.m % 4 AS STRING)) WHEN b.m IS NULL OR b.m % 4 = a.m % 4 THEN concat('risk', CAST(a.m % 4 AS STRING)) ELSE concat('risk', CAST(a.m % 4 AS STRING), '；risk', CAST(b.m % 4 AS STRING)) END AS risk_name,
 CAST(CASE WHEN a.m IS NULL AND b.m IS NULL THEN 0 WHEN a.m IS NULL OR b.m IS NULL OR a.m % 13 = b.m % 13 THEN 1 ELSE 2 END AS BIGINT) AS n_paths
FROM pattern LEFT JOIN module a ON a.m = r1 LEFT JOIN module b ON b.m = r2"""


@Q.add("jon17_tasks_per_pattern", TASKS)
def tasks_per_pattern(spark, sf):
    name = lambda c: F.concat(F.lit("m"), c.cast("string"))
    related = lambda c: F.struct(name(c).alias("module_name"), F.lit(None).cast("string").alias("node_id"), F.lit("").alias("association"))
    patterns = F.array(F.struct(F.lit(None).cast("string").alias("pattern_id"), F.lit(" ").alias("pattern_name")), *[F.struct(F.concat(F.lit("T"), "o_orderstatus").alias("pattern_id"), F.col("o_orderpriority").alias("pattern_name"))] * 2)
    path = F.struct("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("P"), F.col("o_orderkey").cast("string"))).alias("path_id"), F.lit("goal").alias("path_name"), F.lit("").alias("path_description"), F.array(related(F.col("o_custkey") % 90), related(F.col("o_orderkey") % 70)).alias("related"), patterns.alias("patterns"))
    orders = table(spark, sf, "orders")
    total = orders.count()
    trees = dealt(orders, ["o_custkey"], total, WIDE_ROWS).groupBy("o_custkey").agg(F.array_sort(F.collect_list(path)).alias("attack_paths"))
    trees = trees.select(F.col("o_custkey").cast("string").alias("scan_id"), (F.col("o_custkey") % 3).alias("seq"), F.lit(None).cast("string").alias("tree_id"), F.lit("asset").alias("asset_name"), F.lit("").alias("root_node_id"), F.expr("cast(array() as array<struct<node_id:string,node_name:string>>)").alias("nodes"), F.transform("attack_paths", lambda p: p.dropFields("o_orderkey")).alias("attack_paths"))
    number = F.col("s_suppkey") % 60
    modules = table(spark, sf, "supplier").select(name(number).alias("name"), F.col("s_suppkey").alias("seq"), F.concat(F.lit("risk"), (number % 4).cast("string")).alias("threat"), F.array(F.struct(F.concat(F.lit("src/m"), (number % 13).cast("string")).alias("path"), F.lit("d").alias("description"))).alias("paths"))
    return R.tasks_of(trees, modules, total).select("scan_id", "task_id", "pattern_id", "surface_name", "code_path", "risk_name", F.size("code_paths").cast("long").alias("n_paths"))


@Q.add("jon20_dangling_nodes", "SELECT DISTINCT l_partkey AS node_id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def dangling_nodes(spark, sf):
    nodes = table(spark, sf, "part").filter("p_size > 5").select(F.col("p_partkey").alias("node_id"))
    return R.dangling(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("node_id")), nodes)


@Q.add("agg11_tickets", "SELECT vuln_type, count(*) FILTER (WHERE ticket_submitted) AS n FROM findings GROUP BY vuln_type")
def tickets(spark, sf):
    return R.tickets_per_checker(view(spark, sf, "findings"))


@Q.add("agg13_duration_totals", "SELECT l_suppkey, CASE WHEN done > 0 THEN mean * done END AS total FROM (SELECT l_suppkey, CAST(max(l_linenumber) AS DOUBLE) AS mean, count(*) FILTER (WHERE l_quantity > 45) AS done FROM lineitem GROUP BY l_suppkey)")
def duration_totals(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.max("l_linenumber").cast("double").alias("mean"), F.count_if(F.col("l_quantity") > 45).alias("done"))
    return rows.select("l_suppkey", R.duration_total(F.col("mean"), F.col("done")).alias("total"))


@Q.add("agg14_pool_totals", "SELECT r.*, u.unassigned FROM (SELECT CAST(sum(p_size) AS BIGINT) AS running, CAST(sum(p_partkey % 7) AS BIGINT) AS queued FROM part) r CROSS JOIN (SELECT count(*) AS unassigned FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 7 = 0) u")
def pool_totals(spark, sf):
    models = table(spark, sf, "part").select(F.col("p_size").cast("long").alias("running"), (F.col("p_partkey") % 7).alias("queued"))
    tasks = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "completed").otherwise("open").alias("status"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("model_id"))
    return R.pool_totals(models, tasks)


@Q.add("agg24_catalog", "SELECT DISTINCT n_name AS name FROM nation")
def catalog(spark, sf):
    from ..sources.readers import catalog as build

    listed = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "right").groupBy(F.coalesce("c_mktsegment", F.lit("none")).alias("agent")).agg(F.to_json(F.collect_list(F.concat(F.lit(" "), "n_name"))).alias("products"))
    return build(listed)


@Q.add("agg26_path_totals", "SELECT CAST(count(*) AS BIGINT) AS paths, count(DISTINCT o_custkey) AS trees FROM orders")
def path_totals(spark, sf):
    trees = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("paths"))
    return trees.agg(F.sum(F.size("paths")).alias("paths"), F.count(F.lit(1)).alias("trees"))


@Q.add("srt01_exact_first", "WITH asked AS (SELECT DISTINCT concat(lang, '_fn_', CAST(doc_id % 90 AS STRING)) AS request FROM documents) SELECT request, function_id, row_number() OVER (PARTITION BY request ORDER BY CASE WHEN name = request THEN 0 ELSE 1 END, file_path, start_line, function_id) AS place FROM functions JOIN asked ON name = request OR suffix(lower(name), concat('::', lower(request)))")
def exact_first(spark, sf):
    from ..operators.lookup import by_short_names

    asked = docs(spark, sf).select(F.concat("lang", F.lit("_fn_"), (F.col("doc_id") % 90).cast("string")).alias("request")).distinct()
    return by_short_names(view(spark, sf, "functions"), asked).select("request", "function_id", "place")


@Q.add("srt03_newest_first", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders")
def newest_first(spark, sf):
    return R.placed(table(spark, sf, "orders"), R.newest_first("o_orderdate", "o_orderkey"), ["o_custkey"]).select("o_orderkey", "place")


@Q.add("srt05_checker_order", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size > 25, p_size % 3 = 0, p_name, p_partkey) AS place FROM part")
def checker_order(spark, sf):
    rows = table(spark, sf, "part").withColumns({"own": F.col("p_size") > 25, "scans": F.nullif(F.col("p_size") % 3, F.lit(0))})
    return R.placed(rows, [*R.checker_order("own", "scans", "p_name"), "p_partkey"], ["p_brand"]).select("p_partkey", "place")


@Q.add("srt06_catalog_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'O', CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END DESC NULLS LAST, o_orderkey) AS place FROM orders")
def catalog_order(spark, sf):
    rows = table(spark, sf, "orders").withColumns({"own": F.col("o_orderstatus") == "O", "modified": F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate"))})
    return R.placed(rows, R.catalog_order("own", "modified", "o_orderkey"), ["o_custkey"]).select("o_orderkey", "place")


@Q.add("srt07_audit_order", "SELECT finding_id, row_number() OVER (PARTITION BY scan_id ORDER BY coalesce(CASE WHEN finding_id % 3 = 0 THEN finding_id % 5 END, idx), idx) AS place FROM findings")
def audit_order(spark, sf):
    rows = view(spark, sf, "findings").withColumn("audit_index", F.when(F.col("finding_id") % 3 == 0, F.col("finding_id") % 5))
    return R.placed(rows, R.audit_order("audit_index", "idx"), ["scan_id"]).select("finding_id", "place")


@Q.add("srt09_rank_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderkey) AS place FROM orders")
def rank_order(spark, sf):
    return R.placed(table(spark, sf, "orders"), R.rank_order("o_orderstatus", ["F", "P"], "o_orderkey"), ["o_custkey"]).select("o_orderkey", "place")


@Q.add("snk06_markdown", "SELECT finding_id, concat('# ', vuln_type, ': fn', CAST(finding_id AS STRING)) AS title FROM findings")
def markdown(spark, sf):
    from ..sources.writers import markdown as pages

    rows = view(spark, sf, "findings").select(F.col("finding_id").alias("idx"), "vuln_type", F.concat(F.lit("fn"), F.col("finding_id").cast("string")).alias("function"), F.lit("a.c").alias("file"), F.lit(1).alias("line"), "severity", "ai_verdict", F.lit("text").alias("description"))
    found = pages(rows)
    title = F.split("content", "\n")[0]
    return found.select(F.regexp_extract(title, r"fn(\d+)$", 1).cast("long").alias("finding_id"), title.alias("title"))


#: One match a line item. Each metavariable has a value of its own, or none, by the row's keys; a third of the messages name a
#: function in one of the detectors' ways; names that say nothing are among them.
MATCHES = """SELECT row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) + l_orderkey * 1000 AS match_id, l_orderkey % 300 AS f, l_linenumber AS line,
 CASE l_partkey % 5 WHEN 0 THEN 'rules.sub-x' WHEN 1 THEN 'rules.param-assign' WHEN 2 THEN 'rules.add' ELSE 'rules.other' END AS check_id,
 CASE l_suppkey % 4 WHEN 0 THEN concat('Function=`qf', CAST(l_linenumber AS STRING), '` x') WHEN 1 THEN concat('in Function nf', CAST(l_linenumber AS STRING), ' y') WHEN 2 THEN concat('函数 zf', CAST(l_linenumber AS STRING), ' 中') ELSE 'm' END AS message, l_suppkey % 4 AS m, l_partkey, l_suppkey,
 CASE l_partkey % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'unknown' WHEN 2 THEN '$X' END AS func, CASE WHEN l_partkey % 3 = 0 THEN concat('p', CAST(l_suppkey % 3 AS STRING)) END AS p, CASE WHEN l_suppkey % 2 = 0 THEN concat('t', CAST(l_partkey % 2 AS STRING)) ELSE ' ' END AS t, CASE WHEN l_partkey % 7 < 3 THEN concat('fn', CAST(l_partkey % 7 AS STRING)) END AS call,
 CASE WHEN l_suppkey % 5 = 0 THEN 'i' END AS idx FROM lineitem"""
#: Metavariables and the column each is taken from.
CAPTURES = {"FUNC": "func", "F": "func", "P": "p", "DSTSZ": "t", "TYPE": "t", "FIELD": "idx", "REL1": "t", "ROOT": "t", "ACQ": "p", "CALL": "call", "IDX": "idx", "BASE": "t", "ARITH": "p", "DST": "p", "BOUND": "t"}


def matches(spark, sf):
    rows = over(spark, sf, MATCHES, "lineitem")
    held = F.create_map(*[x for k, v in CAPTURES.items() for x in (F.lit(f"${k}"), F.col(v))])
    return rows.select(F.lpad(F.col("match_id").cast("string"), 14, "0").alias("match_id"), F.concat(F.lit("src/f"), F.col("f").cast("string"), F.lit(".c")).alias("path"), "line", "check_id", "message", held.alias("metavars"))


#: For each detector the SQL of the function's name (beside the index) and of the parts of its key.
FUNC, EMPTY = "CASE WHEN func = 'main' THEN 'main' END", lambda c: f"coalesce({c}, '')"
QF, NF, ZF = ("CASE m WHEN %d THEN concat('%s', CAST(line AS STRING)) END" % x for x in ((0, "qf"), (1, "nf"), (2, "zf")))
MATCH_SQL = {
    "intoverflow": ("NULL", True, {"arith": "p", "sink": "coalesce(call || '(...)', nullif(trim(t), '') || '[' || coalesce(idx, p) || ']', '*(' || p || ' +/- ' || p || ')', 'loop bound ' || nullif(trim(t), ''))"}, "file, line, rule"),
    "safe_mem_oob": (f"coalesce({FUNC}, {QF})", False, {"dst": "p", "dst_size": "nullif(trim(t), '')"}, "file, line, rule"),
    "loop_mut_idx_oob": ("NULL", True, {"idx": "idx", "memory": "coalesce(nullif(trim(t), '') || '[' || idx || ']', '(' || p || ' +/- ' || idx || ')->' || idx, p || '->' || idx, '*(' || p || ' +/- ' || idx || ')')"}, "file, line, rule"),
    "bufoverflow": (f"coalesce({FUNC}, {ZF})", True, {"type": "nullif(trim(t), '')", "ptr": "p", "field": "idx"}, "file, function, rule"),
    "double_free": (f"coalesce({FUNC}, {NF})", True, {"type": "nullif(trim(t), '')", "resource": "coalesce(p, idx)", "release": "nullif(trim(t), '')"}, "file, function, rule"),
    "inf_loop": (f"coalesce({FUNC}, {QF})", True, {}, "file, function, rule"),
    "mp_npd": (f"coalesce({QF}, {NF}, {ZF})", True, {"expr": "p", "root": "nullif(trim(t), '')"}, "file, function, rule"),
    "mp_resouce_leak": (f"coalesce({FUNC}, {QF}, {NF}, {ZF})", True, {"field": "idx", "acquire": "p"}, "file, function, rule"),
    "npd_funcret": (f"coalesce({FUNC}, {QF})", True, {"callee": "call", "ptr": "p"}, "file, function"),
}
FROM_MATCHES = """
WITH raw AS ({matches}),
fn AS (SELECT DISTINCT l_orderkey % 300 AS f FROM lineitem WHERE l_orderkey % 300 < 200),
r AS (SELECT raw.*, concat('src/f', CAST(raw.f AS STRING), '.c') AS file, split_part(check_id, '.', 2) AS rule, coalesce({named}, {indexed}, 'unknown') AS function{parts} FROM raw LEFT JOIN fn ON fn.f = raw.f WHERE {kept})
SELECT file, function, rule, coalesce({subject}rule) AS subject, CAST(line AS INT) AS line FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY match_id) AS n2 FROM r) WHERE n2 = 1"""


def _from_matches(detector):
    def query(spark, sf):
        names = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 300).alias("f")).filter("f < 200").distinct()
        path = F.concat(F.lit("f"), F.col("f").cast("string"), F.lit(".c"))
        low = names.select(F.col("f").alias("function_id"), F.concat(F.lit("low"), F.col("f").cast("string")).alias("name"), path.alias("file_path"), F.lit(1).alias("start_line"), F.lit(3).alias("end_line"))
        every = names.select((F.col("f") + 1000).alias("function_id"), F.concat(F.lit("all"), F.col("f").cast("string")).alias("name"), path.alias("file_path"), F.lit(1).alias("start_line"), F.lit(99).alias("end_line"))
        returners = spark.createDataFrame([("fn0", True), ("fn1", False)], "name string, can_return_null boolean")
        found = D.from_matches(matches(spark, sf), low.unionByName(every), detector, returners if detector == "npd_funcret" else None)
        return found.select("file", "function", F.col("metadata")["rule"].alias("rule"), F.col("metadata")["subject"].alias("subject"), "line")

    named, indexed, parts, key = MATCH_SQL[detector]
    names = "CASE WHEN fn.f IS NULL THEN NULL WHEN line <= 3 THEN concat('low', CAST(raw.f AS STRING)) ELSE concat('all', CAST(raw.f AS STRING)) END" if indexed else "NULL"
    sql = FROM_MATCHES.format(
        matches=MATCHES, named=named, indexed=names, parts="".join(f", coalesce({v}, '') AS k_{k}" for k, v in parts.items()), subject="".join(f"nullif(k_{k}, ''), " for k in parts), key=", ".join([key, *(f"k_{k}" for k in parts)]),
        kept="check_id LIKE '%param-assign%' OR coalesce(call, '') <> 'fn1'" if detector == "npd_funcret" else "TRUE",
    )
    Q.add(f"det_matches_{detector}", sql)(query)


for _detector in D.MATCH_DETECTORS:
    _from_matches(_detector)


ERRORS = "SELECT o_orderkey % 400 AS f, o_custkey % 60 + 1 AS line, CASE o_orderkey % 4 WHEN 0 THEN 'memleak' WHEN 1 THEN 'resourceLeak' WHEN 2 THEN 'nullPointer' ELSE 'memleakOnRealloc' END AS id, o_orderkey FROM orders"
HOLDERS = "SELECT f AS function_id, f, concat('fn', CAST(f AS STRING)) AS name, concat('f', CAST(f AS STRING), '.c') AS file_path, 1 AS start_line, 30 AS end_line, CASE f % 3 WHEN 0 THEN 'sem_wait(s); if (x) return 1; return 0;' WHEN 1 THEN 'sem_wait(s); if (x) return 1; sem_post(s); return 0;' ELSE 'return 0;' END AS body FROM (SELECT DISTINCT o_orderkey % 500 AS f FROM orders)"


@Q.add("det_resleak", f"""
WITH e AS (SELECT concat('f', CAST(f AS STRING), '.c') AS file, CASE WHEN line <= 30 THEN concat('fn', CAST(f AS STRING)) ELSE '<unknown>' END AS function, min(line) AS line FROM ({ERRORS}) WHERE id <> 'nullPointer' GROUP BY ALL)
SELECT file, function, CAST(line AS INT) AS line, FALSE AS locked FROM e UNION ALL SELECT file_path, name, 1, TRUE FROM ({HOLDERS}) h WHERE f % 3 < 2 AND NOT EXISTS (SELECT 1 FROM e WHERE e.file = h.file_path AND e.function = h.name)""")
def resleak(spark, sf):
    errors = over(spark, sf, ERRORS, "orders").select("id", F.lit("error").alias("severity"), F.concat(F.lit("f"), F.col("f").cast("string"), F.lit(".c")).alias("file"), "line", F.lit("m").alias("message"))
    found = D.resource_leaks(errors, over(spark, sf, HOLDERS, "orders"))
    return found.select("file", "function", "line", F.col("metadata")["subject"].startswith("sem_wait").alias("locked"))


@Q.add("src03_ignored_path", "SELECT page_id, contains(url, '/example/') AS ignored FROM (SELECT page_id, concat('a/', CASE WHEN page_id % 3 = 0 THEN 'example/' ELSE '' END, 'x.c') AS url FROM pages)")
def ignored_path(spark, sf):
    from ..sources.readers import in_skipped_dir

    path = F.concat(F.lit("a\\"), F.when(F.col("page_id") % 3 == 0, "example\\").otherwise(""), F.lit("x.c"))
    return table(spark, sf, "pages").select("page_id", in_skipped_dir(path, ["example"], ()).alias("ignored"))


@Q.add("set06_tree_concatenation", "SELECT c_custkey AS id, 'customer' AS kind FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_suppkey, 'supplier' FROM supplier WHERE s_acctbal < 0")
def tree_concatenation(spark, sf):
    from ..operators.candidates import concatenate

    parts = [table(spark, sf, name).filter(f"{name[0]}_acctbal < 0").select(F.col(f"{name[0]}_{key}").alias("id"), F.lit(name).alias("kind")) for name, key in (("customer", "custkey"), ("supplier", "suppkey"))]
    return concatenate(parts)


@Q.add("srt02_innermost", "WITH place AS (SELECT file_path AS p, start_line AS line FROM functions ORDER BY start_line DESC, file_path, function_id LIMIT 1) SELECT function_id FROM functions JOIN place ON file_path = p AND line BETWEEN start_line AND end_line ORDER BY end_line - start_line, file_path, function_id LIMIT 1")
def innermost(spark, sf):
    """At the line where the last function begins."""
    functions = view(spark, sf, "functions")
    place = functions.orderBy(F.desc("start_line"), "file_path", "function_id").select("file_path", "start_line").first()
    found = functions.filter((F.col("file_path") == place.file_path) & F.lit(place.start_line).between(F.col("start_line"), F.col("end_line")))
    return found.orderBy(F.col("end_line") - F.col("start_line"), "file_path", "function_id").limit(1).select("function_id")


@Q.add("st11_resume_outputs", """
WITH stored AS (SELECT l_partkey AS k, max(CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE concat('{"n": ', CAST(l_orderkey AS VARCHAR), '}') END) AS output FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey)
SELECT p_partkey AS position, CASE WHEN output IS NOT NULL THEN output ELSE concat('{"ran": ', CAST(p_partkey AS VARCHAR), '}') END AS output, output IS NOT NULL AS resumed FROM part LEFT JOIN stored ON k = p_partkey WHERE output IS NOT NULL OR p_partkey % 3 <> 0""")
def resume_outputs(spark, sf):
    """Stored outputs are line items' JSON, some of it broken off; of what runs every third task gives nothing."""
    from ..operators.candidates import restored, resume_tasks

    tasks = table(spark, sf, "part").select(F.col("p_partkey").alias("task_id"), F.col("p_partkey").alias("position"))
    text = F.concat(F.lit('{"n": '), F.col("l_orderkey").cast("string"), F.when(F.col("l_linenumber") % 4 == 0, "").otherwise("}"))
    stored = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("task_id"), text.alias("output"))
    reused, pending = resume_tasks(tasks, stored)
    results = pending.filter("task_id % 3 <> 0").select("task_id", F.concat(F.lit('{"ran": '), F.col("task_id").cast("string"), F.lit("}")).alias("output"))
    return restored(reused, pending, results).select("position", "output", "resumed")
