"""Queries of result analytics: metrics, latest reviews, lists, dashboards, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import metrics as M
from ..operators import results as R
from ..operators.candidates import keep_first
from .views import Queries, table, view

Q = Queries()
QUERIES, SQL = Q.functions, Q.sql

LATEST = """SELECT finding_id, verdict, seq FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY created_at DESC, seq DESC) AS n FROM reviews WHERE verdict IN ('tp', 'fp') AND NOT starts_with(reason, 'no result')) WHERE n = 1"""
COUNTS = """count(*) AS static_issue_count, count(*) FILTER (WHERE llm) AS llm_issue_count, count(*) FILTER (WHERE review_verdict = 'tp') AS fp_review_issue_count,
 count(*) FILTER (WHERE review_verdict = 'fp') AS fp_review_false_positive_count, count(*) FILTER (WHERE user_verdict = 'confirmed') AS human_confirmed_count,
 count(*) FILTER (WHERE user_verdict = 'false_positive') AS human_false_positive_count, count(*) FILTER (WHERE review_verdict = 'tp' OR (review_verdict IS NULL AND llm)) AS accuracy_basis_count"""
JUDGED = f"latest AS ({LATEST}), judged AS (SELECT f.*, l.verdict AS review_verdict, CASE WHEN coalesce(ai_verdict, '') <> '' THEN ai_verdict = 'confirmed' ELSE confirmed END AS llm FROM findings f LEFT JOIN latest l ON l.finding_id = f.finding_id)"


def metrics_sql(by: str, where: str = "TRUE") -> str:
    return f"WITH {JUDGED}, c AS (SELECT {by}, {COUNTS} FROM judged WHERE {where} GROUP BY {by}) SELECT *, llm_issue_count - fp_review_false_positive_count AS effective_issue_count, CASE WHEN accuracy_basis_count > 0 THEN round(human_confirmed_count / accuracy_basis_count, 4) END AS accuracy FROM c"


def latest(spark, sf):
    return M.latest_reviews(view(spark, sf, "reviews"), ["finding_id"], ["created_at", "seq"])


def judged(spark, sf):
    return M.reviewed(view(spark, sf, "findings"), latest(spark, sf), ["finding_id"])


@Q.add("win03_latest_review", LATEST)
def latest_review(spark, sf):
    return latest(spark, sf).select("finding_id", "verdict", "seq")


@Q.add("win04_latest_job", "SELECT user_id, max(event_id) AS event_id FROM (SELECT user_id, event_id, rank() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r = 1 GROUP BY user_id")
def latest_job(spark, sf):
    return keep_first(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@Q.add("agg05_issue_metrics_by_scan", metrics_sql("scan_id"))
def metrics_by_scan(spark, sf):
    return M.issue_metrics(judged(spark, sf), ["scan_id"])


@Q.add("agg05_issue_metrics_by_checker", metrics_sql("vuln_type"))
def metrics_by_checker(spark, sf):
    return M.issue_metrics(judged(spark, sf), ["vuln_type"])


@Q.add("agg05_issue_metrics_one_checker", metrics_sql("scan_id", "vuln_type = '1-URGENT'"))
def metrics_one_checker(spark, sf):
    return M.issue_metrics(judged(spark, sf), ["scan_id"], "1-URGENT")


@Q.add("agg06_is_llm_issue", "SELECT finding_id, coalesce(CASE WHEN coalesce(ai_verdict, '') <> '' THEN ai_verdict = 'confirmed' ELSE confirmed END, FALSE) AS llm FROM findings")
def is_llm_issue(spark, sf):
    return view(spark, sf, "findings").select("finding_id", M.is_llm_issue(F.col("ai_verdict"), F.col("confirmed")).alias("llm"))


@Q.add("agg07_ratio", "SELECT o_custkey, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'O') > 0 THEN round(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*) FILTER (WHERE o_orderstatus = 'O'), 4) END AS share FROM orders GROUP BY o_custkey")
def ratio(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(M.ratio(F.count_if(F.col("o_orderpriority") == "1-URGENT"), F.count_if(F.col("o_orderstatus") == "O")).alias("share"))


@Q.add("agg02_scan_list", "SELECT s.scan_id, s.scan_name, n.n_name AS username, coalesce(f.c, 0) AS n_findings FROM scans s LEFT JOIN nation n ON n.n_nationkey = s.user_id LEFT JOIN (SELECT scan_id, count(*) AS c FROM findings WHERE price > 300000 GROUP BY scan_id) f ON f.scan_id = s.scan_id")
def scan_list(spark, sf):
    users = table(spark, sf, "nation").select(F.col("n_nationkey").alias("user_id"), F.col("n_name").alias("username"))
    scans = view(spark, sf, "scans").join(users, "user_id", "left")
    found = M.count_per(scans, view(spark, sf, "findings"), "scan_id", "n_findings", F.col("price") > 300000)
    return found.orderBy(F.desc("balance"), "scan_id").select("scan_id", "scan_name", "username", "n_findings")


@Q.add("agg03_open_tasks", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey")
def open_tasks(spark, sf):
    return R.open_tasks(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", "F")


@Q.add("agg08_effective_count", f"WITH {JUDGED} SELECT scan_id, count(*) FILTER (WHERE llm) - count(*) FILTER (WHERE review_verdict = 'fp') AS effective FROM judged GROUP BY scan_id")
def effective_count(spark, sf):
    rows = judged(spark, sf).groupBy("scan_id").agg(F.count_if(M.is_llm_issue(F.col("ai_verdict"), F.col("confirmed"))).alias("llm"), F.count_if(F.col("review_verdict") == "fp").alias("fp"))
    return rows.select("scan_id", M.effective_count(F.col("llm"), F.col("fp")).alias("effective"))


DASHBOARD = f"""
WITH {JUDGED}, used AS (SELECT scan_id, project, unnest(CASE WHEN scan_id % 3 = 0 THEN ['1-URGENT', '2-HIGH'] WHEN scan_id % 3 = 1 THEN ['2-HIGH', 'extra'] ELSE ['3-MEDIUM', '5-LOW', 'extra'] END) AS checker FROM scans WHERE {{where}}),
per AS (SELECT checker, count(*) AS scan_count, count(DISTINCT project) AS project_count FROM used GROUP BY checker),
cnt AS (SELECT vuln_type AS checker, {COUNTS}, count(*) FILTER (WHERE ticket_submitted) AS ticket_submitted_count FROM judged j WHERE EXISTS (SELECT 1 FROM used u WHERE u.scan_id = j.scan_id AND u.checker = j.vuln_type) GROUP BY vuln_type),
reg AS (SELECT DISTINCT o_orderpriority AS checker, o_orderpriority = '5-LOW' AS user_created FROM orders),
names AS (SELECT coalesce(reg.checker, per.checker) AS checker, coalesce(user_created, FALSE) AS user_created, coalesce(scan_count, 0) AS scan_count, coalesce(project_count, 0) AS project_count FROM reg FULL JOIN per ON per.checker = reg.checker),
d AS (SELECT n.*, coalesce(static_issue_count, 0) AS static_issue_count, coalesce(llm_issue_count, 0) AS llm_issue_count, coalesce(fp_review_issue_count, 0) AS fp_review_issue_count, coalesce(fp_review_false_positive_count, 0) AS fp_review_false_positive_count,
 coalesce(human_confirmed_count, 0) AS human_confirmed_count, coalesce(human_false_positive_count, 0) AS human_false_positive_count, coalesce(accuracy_basis_count, 0) AS accuracy_basis_count, coalesce(ticket_submitted_count, 0) AS ticket_submitted_count FROM names n LEFT JOIN cnt ON cnt.checker = n.checker)
"""
RATES = "SELECT *, CASE WHEN accuracy_basis_count > 0 THEN round(human_confirmed_count / accuracy_basis_count, 4) END AS accuracy, CASE WHEN accuracy_basis_count > 0 THEN round(ticket_submitted_count / accuracy_basis_count, 4) END AS ticket_accuracy FROM d"
SUMMARY = "SELECT count(*) AS checker_count, CAST(sum(static_issue_count) AS BIGINT) AS static_issue_count, CAST(sum(llm_issue_count) AS BIGINT) AS llm_issue_count, CAST(sum(fp_review_false_positive_count) AS BIGINT) AS fp_review_false_positive_count, CAST(sum(human_confirmed_count) AS BIGINT) AS human_confirmed_count, CAST(sum(ticket_submitted_count) AS BIGINT) AS ticket_submitted_count, CAST(sum(accuracy_basis_count) AS BIGINT) AS accuracy_basis_count, CAST(sum(llm_issue_count) - sum(fp_review_false_positive_count) AS BIGINT) AS total_issue_count, CASE WHEN sum(accuracy_basis_count) > 0 THEN round(sum(human_confirmed_count) / sum(accuracy_basis_count), 4) END AS accuracy FROM d WHERE NOT user_created"


def _dashboard(spark, sf, product=None):
    m = F.col("scan_id") % 3
    items = F.when(m == 0, F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).when(m == 1, F.array(F.lit("2-HIGH"), F.lit("extra"))).otherwise(F.array(F.lit("3-MEDIUM"), F.lit("5-LOW"), F.lit("extra")))
    scans = view(spark, sf, "scans").withColumn("scan_items", items)
    registry = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("checker"), (F.col("o_orderpriority") == "5-LOW").alias("user_created")).distinct()
    return M.checker_dashboard(registry, scans, judged(spark, sf), product)


@Q.add("agg09_dashboard", DASHBOARD.format(where="TRUE") + RATES)
def dashboard(spark, sf):
    return _dashboard(spark, sf)


@Q.add("flt18_dashboard_product", DASHBOARD.format(where="product = 'BUILDING'") + RATES)
def dashboard_product(spark, sf):
    return _dashboard(spark, sf, "BUILDING")


@Q.add("flt18_dashboard_unconfigured", DASHBOARD.format(where="product = ''") + RATES)
def dashboard_unconfigured(spark, sf):
    return _dashboard(spark, sf, "__unconfigured__")


@Q.add("agg10_dashboard_summary", DASHBOARD.format(where="TRUE") + SUMMARY)
def dashboard_summary(spark, sf):
    return M.dashboard_summary(_dashboard(spark, sf))


POOL = """SELECT l_suppkey AS model_id, count(*) AS total, count(*) FILTER (WHERE l_returnflag <> 'R') AS success, count(*) FILTER (WHERE l_returnflag = 'R') AS failed, CAST(sum(l_linenumber * 100) AS BIGINT) AS duration_ms,
 max_by(l_linestatus, l_orderkey * 100000000000 + l_linenumber * 10000000000 + l_partkey) FILTER (WHERE l_quantity > 10) AS label, round(CAST(sum(l_linenumber * 100) AS DOUBLE) / count(*), 2) AS avg_ms FROM lineitem GROUP BY l_suppkey"""


@Q.add("agg12_pool_stats", POOL)
def pool_stats(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("model_id"), F.lit(1).alias("total"), (F.col("l_returnflag") != "R").cast("int").alias("success"), (F.col("l_returnflag") == "R").cast("int").alias("failed"), (F.col("l_linenumber") * 100).alias("duration_ms"), F.when(F.col("l_quantity") > 10, F.col("l_linestatus")).otherwise("").alias("label"), F.expr("l_orderkey * 100000000000L + l_linenumber * 10000000000L + l_partkey").alias("updated_at"), F.col("l_orderkey").alias("session_id"))
    return M.pool_stats(rows)


@Q.add("agg15_facets", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def facets(spark, sf):
    return M.facet_counts(table(spark, sf, "orders"), "o_orderpriority")


@Q.add("agg15_facets_with_zeros", "SELECT n_name AS label, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9900 GROUP BY n_name")
def facets_with_zeros(spark, sf):
    nation = table(spark, sf, "nation")
    rich = table(spark, sf, "customer").filter("c_acctbal > 9900").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("label"))
    return M.facet_counts(rich, "label", nation.select(F.col("n_name").alias("label")))


@Q.add("agg16_leak_groups", "SELECT l_orderkey AS file, min(l_linenumber) AS line, (SELECT string_agg(r, ', ' ORDER BY r) FROM (SELECT DISTINCT l_returnflag AS r FROM lineitem b WHERE b.l_orderkey = a.l_orderkey)) AS releases FROM lineitem a GROUP BY l_orderkey")
def leak_groups(spark, sf):
    from ..operators.detectors import leak_issues

    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.lit("f").alias("function"), F.lit(1).alias("start_line"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("release"), F.col("l_partkey").cast("string").alias("details"))
    return leak_issues(rows).select("file", "line", "releases")


@Q.add("agg17_merge_assets", "SELECT o_custkey, string_agg(o_orderpriority, chr(10) ORDER BY first) AS text FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY o_custkey, o_orderpriority) GROUP BY o_custkey")
def merge_assets(spark, sf):
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("all"))
    from ..functions.text import merge_text

    return rows.select("o_custkey", F.aggregate("all", F.lit(""), lambda text, x: merge_text(text, x["o_orderpriority"])).alias("text"))


@Q.add("agg19_option_lists", "SELECT DISTINCT product AS option FROM scans WHERE product <> ''")
def option_lists(spark, sf):
    return R.options(view(spark, sf, "scans"), "product")


@Q.add("agg20_group_by_title", "SELECT trim(event_type) AS title, min(event_id) AS place, count(*) AS n FROM events GROUP BY 1")
def group_by_title(spark, sf):
    return R.grouped_by_title(table(spark, sf, "events").select(F.concat(F.lit(" "), "event_type").alias("title"), "event_id"), "event_id")


@Q.add("agg21_percent", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN least(100.0, greatest(0.0, round(100.0 * (o_orderkey % 13) / (o_orderkey % 10)))) ELSE 0.0 END AS pct FROM orders")
def percent(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", M.percent(F.expr("o_orderkey % 13"), F.expr("o_orderkey % 10")).alias("pct"))


@Q.add("agg22_capacity", "SELECT least(CAST(coalesce(sum(p_size), 0) AS BIGINT), 40000) AS capacity FROM part WHERE p_retailprice > 1000")
def capacity(spark, sf):
    models = table(spark, sf, "part").select((F.col("p_retailprice") > 1000).alias("eligible"), F.col("p_size").alias("max_concurrency"))
    return M.capacity(models, 40000)


@Q.add("agg23_distinct_text", "SELECT o_custkey, string_agg(o_orderstatus, '；' ORDER BY first) AS risks FROM (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS first FROM orders GROUP BY o_custkey, o_orderstatus) GROUP BY o_custkey")
def distinct_text(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(M.distinct_text(F.col("o_orderstatus"), F.col("o_orderkey")).alias("risks"))


@Q.add("agg27_ordered_text", "SELECT conv_id, string_agg(role, '|' ORDER BY turn) AS roles FROM (SELECT DISTINCT conv_id, turn, role FROM conversations WHERE trim(role) <> '') GROUP BY conv_id")
def ordered_text(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role").distinct()
    return rows.groupBy("conv_id").agg(M.ordered_text(F.col("role"), F.col("turn"), "|").alias("roles"))


@Q.add("win06_stage_map", "SELECT conv_id, role, max_by(length(text), turn * 1000000 + length(text)) AS n FROM conversations WHERE role IS NOT NULL GROUP BY conv_id, role")
def stage_map(spark, sf):
    rows = table(spark, sf, "conversations").filter("role IS NOT NULL").withColumn("n", F.length("text"))
    last = keep_first(rows, ["conv_id", "role"], [F.desc("turn"), F.desc("n")])
    stages = last.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("stages"))
    return stages.select("conv_id", F.explode("stages").alias("role", "n")).select("conv_id", "role", F.col("n").cast("long").alias("n"))


@Q.add("win09_running_max", "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM events")
def running_max(spark, sf):
    return table(spark, sf, "events").select("event_id", M.running_max("value", ["user_id"], ["ts", "event_id"]).alias("top"))


@Q.add("win10_last_events", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def last_events(spark, sf):
    return M.last_per_key(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], 5).select("user_id", "event_id")


@Q.add("win12_progress_samples", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS t FROM events) WHERE n % 4 = 0 OR n = t")
def progress_samples(spark, sf):
    return R.progress_samples(table(spark, sf, "events"), ["user_id"], ["event_id"], 4).select("user_id", "event_id")


@Q.add("jon10_findings_with_scan", "SELECT f.finding_id, s.project FROM findings f JOIN scans s ON s.scan_id = f.scan_id WHERE s.project = 'project7'")
def findings_with_scan(spark, sf):
    return R.of_project(view(spark, sf, "findings"), view(spark, sf, "scans"), "project7").select("finding_id", "project")


@Q.add("jon11_reviews_with_jobs", "SELECT l_orderkey AS job, o_orderstatus AS status, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS seq, row_number() OVER (PARTITION BY l_orderkey ORDER BY o_orderdate, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey) AS place FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def reviews_with_jobs(spark, sf):
    jobs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job"), F.expr("l_linenumber * 10000000000L + l_partkey * 10000 + l_suppkey").alias("seq"))
    return R.reviews_of_jobs(rows, jobs).select("job", "status", "seq", "place")


@Q.add("jon12_reconcile_semi", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'cancelled' ELSE o_orderstatus END AS status FROM orders")
def reconcile_semi(spark, sf):
    dead = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return E.reconcile_offline(table(spark, sf, "orders"), dead, "o_custkey", "o_orderstatus", ["P"], "cancelled").select("o_orderkey", F.col("o_orderstatus").alias("status"))


@Q.add("jon13_candidate_finding_validation", "WITH last_ AS (SELECT l_orderkey AS k, max(l_partkey * 100000 + l_suppkey) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) SELECT o_orderkey, last_.v, quality FROM orders LEFT JOIN last_ ON k = o_orderkey LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) q ON q.doc_id = o_orderkey")
def candidate_finding_validation(spark, sf):
    findings = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.expr("l_partkey * 100000 + l_suppkey").alias("v"))
    last = keep_first(findings, ["o_orderkey"], [F.desc("v")])
    quality = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("o_orderkey")).agg(F.max("quality").alias("quality"))
    return table(spark, sf, "orders").join(last, "o_orderkey", "left").join(quality, "o_orderkey", "left").select("o_orderkey", "v", "quality")


@Q.add("jon14_finding_review", f"WITH {JUDGED} SELECT finding_id, review_verdict, CASE WHEN user_verdict IS NOT NULL THEN user_verdict WHEN review_verdict = 'fp' THEN 'false_positive' WHEN llm THEN 'confirmed' ELSE 'not_confirmed' END AS state FROM judged")
def finding_review(spark, sf):
    llm = M.is_llm_issue(F.col("ai_verdict"), F.col("confirmed"))
    state = F.when(F.col("user_verdict").isNotNull(), F.col("user_verdict")).when(F.col("review_verdict") == "fp", "false_positive").when(llm, "confirmed").otherwise("not_confirmed")
    return judged(spark, sf).select("finding_id", "review_verdict", state.alias("state"))


@Q.add("jon16_first_name_match", "WITH names AS (SELECT o_orderkey, unnest([concat(' Cust ', CAST(o_custkey * 2 AS STRING)), concat('cust', CAST(o_custkey AS STRING)), 'CUST 1']) AS name, unnest([0, 1, 2]) AS r FROM orders), m AS (SELECT o_orderkey, c_custkey, r FROM names JOIN customer ON concat('cust', CAST(c_custkey AS STRING)) = lower(replace(name, ' ', '')) WHERE c_custkey % 3 <> 0) SELECT o_orderkey, min_by(c_custkey, r) AS c_custkey FROM m GROUP BY o_orderkey")
def first_name_match(spark, sf):
    from ..functions.text import folded

    names = table(spark, sf, "orders").select("o_orderkey", F.posexplode(F.array(F.concat(F.lit(" Cust "), (F.col("o_custkey") * 2).cast("string")), F.concat(F.lit("cust"), F.col("o_custkey").cast("string")), F.lit("CUST 1"))).alias("r", "name"))
    modules = table(spark, sf, "customer").filter("c_custkey % 3 <> 0").select("c_custkey", folded(F.concat(F.lit("Cust "), F.col("c_custkey").cast("string"))).alias("k"))
    return names.join(modules, folded(F.col("name")) == F.col("k")).groupBy("o_orderkey").agg(F.min_by("c_custkey", "r").alias("c_custkey"))


@Q.add("jon23_review_progress", "SELECT o_custkey, count(*) AS total, count(l) AS done FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS l FROM lineitem WHERE l_quantity > 48) x ON l = o_orderkey GROUP BY o_custkey")
def review_progress(spark, sf):
    results = table(spark, sf, "lineitem").filter("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.progress_of_jobs(table(spark, sf, "orders"), results, "o_custkey", ["o_orderkey"])


@Q.add("srt04_unreviewed_first", f"WITH {JUDGED}, o AS (SELECT scan_id, finding_id, row_number() OVER (PARTITION BY scan_id ORDER BY review_verdict IS NOT NULL, idx) AS place FROM judged) SELECT finding_id, place FROM o")
def unreviewed_first(spark, sf):
    return R.placed(judged(spark, sf), R.unreviewed_first("review_verdict", "idx"), ["scan_id"]).select("finding_id", "place")


@Q.add("srt08_queue_order", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN epoch(date_trunc('second', ts)) ELSE -epoch(date_trunc('second', ts)) END NULLS LAST, event_id) AS place FROM events")
def queue_order(spark, sf):
    from pyspark.sql.window import Window

    status = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "purchase", "planned").otherwise("done")
    rows = table(spark, sf, "events").withColumn("status", status)
    over = Window.partitionBy("user_id").orderBy(*E.queue_order("status", "ts"), "event_id")
    return rows.select("event_id", F.row_number().over(over).cast("long").alias("place"))


@Q.add("srt10_scheduler_pick", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS place FROM part")
def scheduler_pick(spark, sf):
    return R.placed(table(spark, sf, "part"), R.scheduler_order("p_size", "p_partkey"), ["p_brand"]).select("p_partkey", "place")


@Q.add("srt11_model_pick", "SELECT p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 3, (p_partkey % 7) / (1.0 + p_size % 4), p_partkey % 7, 1 + p_size % 4 DESC, p_retailprice, p_partkey) AS place FROM part")
def model_pick(spark, sf):
    from pyspark.sql.window import Window

    rows = table(spark, sf, "part").selectExpr("p_partkey AS id", "p_brand", "p_size % 3 AS capability", "p_partkey % 7 AS running", "1 + p_size % 4 AS weight", "p_retailprice AS last_used")
    return rows.select("id", F.row_number().over(Window.partitionBy("p_brand").orderBy(*E.model_order())).cast("long").alias("place"))


@Q.add("lim01_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def page(spark, sf):
    return M.page(table(spark, sf, "orders"), [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_orderkey", "o_totalprice")
