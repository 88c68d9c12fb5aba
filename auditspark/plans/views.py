"""The driver's tables in the roles of the engine's relations; the same SQL serves Spark and the SQL side."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    # Functions: documents as bodies; names repeat, some are qualified; a function
    # begins 400 lines after that of the document before, so long ones hold others.
    "functions": """
        SELECT doc_id AS function_id,
               CASE WHEN doc_id % 3 = 0 THEN concat(lang, '_fn_', CAST(doc_id % 90 AS STRING)) ELSE concat('Ns', CAST(doc_id % 7 AS STRING), '::', lang, '_fn_', CAST(doc_id % 90 AS STRING)) END AS name,
               concat('int ', lang, '_fn_', CAST(doc_id % 90 AS STRING), '(void) /* Ns', CAST(doc_id % 5 AS STRING), '::', lang, '_fn_', CAST(doc_id % 90 AS STRING), ' */') AS signature,
               concat('root/', source, '/', lang, '.c') AS file_path,
               doc_id * 400 + 1 AS start_line,
               doc_id * 400 + 1 + n_chars + (doc_id % 4) * 500 AS end_line,
               doc_id % 2 = 0 AS is_static, text AS body, source, lang
        FROM documents""",
    # Files: one a source and language.
    "files": """SELECT DISTINCT concat('root/', source, '/', lang, '.c') AS file_path, concat(source, ':', lang) AS label FROM documents""",
    # Calls: line items as edges from orders; callees are named, some of them not defined.
    "calls": """
        SELECT l_orderkey AS caller_key, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp,
               CASE WHEN l_partkey % 4 = 0 THEN concat('Ns', CAST(l_partkey % 7 AS STRING), '::en_fn_', CAST(l_partkey % 120 AS STRING)) ELSE concat('en_fn_', CAST(l_partkey % 120 AS STRING)) END AS callee_name
        FROM lineitem""",
    # Candidates: line items, whose key (order, line) repeats; ord is unique within a key.
    "candidates": """
        SELECT concat('f', CAST(l_orderkey % 5000 AS STRING), '.c') AS file, l_linenumber AS line, concat('fn', CAST(l_orderkey AS STRING)) AS function, l_returnflag AS vuln_type,
               l_orderkey, l_linenumber, l_partkey * 100000 + l_suppkey AS seq, l_linestatus AS family, l_quantity AS quantity
        FROM lineitem""",
    # Findings: orders, in scans that are customers.
    "findings": """
        SELECT o_custkey AS scan_id, o_orderkey AS finding_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx, o_orderpriority AS vuln_type, o_orderstatus AS severity,
               o_orderkey % 3 = 0 AS confirmed,
               CASE o_orderkey % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN '' WHEN 2 THEN 'not_confirmed' WHEN 3 THEN 'timeout' END AS ai_verdict,
               CASE o_orderkey % 7 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'false_positive' WHEN 2 THEN 'pending' END AS user_verdict,
               o_orderkey % 11 = 0 AS ticket_submitted, o_totalprice AS price
        FROM orders""",
    # Reviews: line items of an order, by day of shipping; seq breaks ties.
    "reviews": """
        SELECT l_orderkey AS finding_id, CASE l_linenumber % 3 WHEN 0 THEN 'tp' WHEN 1 THEN 'fp' ELSE 'uncertain' END AS verdict,
               CASE WHEN l_partkey % 10 = 0 THEN 'no result: stopped' ELSE 'read' END AS reason, l_shipdate AS created_at, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS seq
        FROM lineitem""",
    "scans": """SELECT c_custkey AS scan_id, c_name AS scan_name, concat('project', CAST(c_custkey % 40 AS STRING)) AS project, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_mktsegment END AS product, c_nationkey AS user_id, c_acctbal AS balance FROM customer""",
    # Events: users as scans, types as phases.
    "scan_events": """
        SELECT user_id AS scan_id, event_id AS seq, ts,
               CASE WHEN event_type = 'signup' THEN 'static_analysis' WHEN event_type = 'purchase' THEN 'auditing' WHEN event_type = 'error' THEN 'error' WHEN event_id % 13 = 0 THEN 'completed' WHEN event_id % 3 = 0 THEN 'static_analysis' WHEN event_id % 5 = 0 THEN 'auditing' ELSE 'init' END AS phase,
               event_type AS message, value, props
        FROM events""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = [t for t in TABLES if re.search(rf"\b{t}\b", VIEWS[name])]
    text = VIEWS[name]
    for t in used:
        text = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def with_views(sql: str) -> str:
    """The SQL with the views that it names as common table expressions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    sql = sql.strip()
    if not head:
        return sql
    return f"WITH RECURSIVE {head}, {sql[len('WITH RECURSIVE '):]}" if sql.startswith("WITH RECURSIVE ") else f"WITH {head}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {head} {sql}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, for queries of sinks: below ``spark.checkpoint.dir``, or in local mode a
    temporary one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="audit-scratch-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Queries:
    """Collects named queries and their SQL."""

    def __init__(self):
        self.functions, self.sql = {}, {}

    def add(self, name: str, sql: str | None = None):
        def keep(f):
            self.functions[name] = f
            if sql is not None:
                self.sql[name] = with_views(sql)
            return f

        return keep
