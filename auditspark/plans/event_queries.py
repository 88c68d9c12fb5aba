"""Queries over event logs, in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import results as R
from .views import Queries, table, view

Q = Queries()
QUERIES, SQL = Q.functions, Q.sql

RANK = "CASE WHEN phase IN ('analyzing', 'static_analysis') THEN 1 WHEN phase = 'auditing' THEN 2 WHEN phase IN ('completed', 'error', 'cancelled') THEN 3 ELSE 0 END"


@Q.add("st02_phase_machine", f"SELECT scan_id, CASE max(r) WHEN 3 THEN min_by(phase, seq) FILTER (WHERE r = 3) WHEN 2 THEN 'auditing' WHEN 1 THEN 'analyzing' ELSE 'pending' END AS status, bool_or(r >= 2) AS static_done, count(*) AS n_events, max_by(message, seq) AS last_message FROM (SELECT *, {RANK} AS r FROM scan_events) GROUP BY scan_id")
def phase_machine(spark, sf):
    return E.scan_states(view(spark, sf, "scan_events"))


@Q.add("st03_status_history", f"SELECT seq, max({RANK}) OVER (PARTITION BY scan_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS status_rank FROM scan_events")
def status_history(spark, sf):
    return E.status_history(view(spark, sf, "scan_events")).select("seq", "status_rank")


@Q.add("st01_replay", "SELECT scan_id, seq, row_number() OVER (PARTITION BY scan_id ORDER BY seq) AS place FROM scan_events WHERE seq > 20")
def replay(spark, sf):
    events = view(spark, sf, "scan_events")
    return R.replay(events.unionByName(events.filter("seq % 5 = 0")), "scan_id", 20).select("scan_id", "seq", "place")


@Q.add("flt20_phase_filter", "SELECT seq FROM scan_events WHERE phase IN ('auditing', 'error')")
def phase_filter(spark, sf):
    return R.in_phases(view(spark, sf, "scan_events"), ["auditing", "error"]).select("seq")


@Q.add("st04_processed_counts", "SELECT c_custkey AS scan_id, greatest(coalesce(n, 0), c_custkey % 5) AS processed FROM customer LEFT JOIN (SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY user_id) e ON user_id = c_custkey")
def processed_counts(spark, sf):
    stored = table(spark, sf, "customer").selectExpr("c_custkey AS scan_id", "c_custkey % 5 AS processed")
    done = table(spark, sf, "events").withColumnRenamed("user_id", "scan_id")
    return E.processed_counts(done, stored, "scan_id", ["event_type"])


SNAPSHOT = """
WITH s AS (SELECT o_custkey AS session, o_orderpriority AS model, CAST(floor(o_orderkey / 50) AS BIGINT) AS seq, max(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3), last_ AS (SELECT session, max(seq) AS m FROM s GROUP BY session)
SELECT k.session, k.model, c.v IS NOT NULL AS enabled, c.v FROM (SELECT DISTINCT session, model FROM s) k LEFT JOIN (SELECT s.* FROM s JOIN last_ ON last_.session = s.session AND m = seq) c ON c.session = k.session AND c.model = k.model"""


@Q.add("st06_latest_snapshots", SNAPSHOT)
def latest_snapshots(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("session"), F.col("o_orderpriority").alias("model"), F.floor(F.col("o_orderkey") / 50).alias("seq")).agg(F.max("o_totalprice").alias("v"))
    return E.latest_snapshots(rows, rows, "session", "model").select("session", "model", "enabled", "v")


@Q.add("st07_settled", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_custkey END AS running FROM orders")
def settled(spark, sf):
    rows = table(spark, sf, "orders").withColumns({"status": F.when(F.col("o_orderstatus") == "F", "completed").otherwise("auditing"), "running": F.col("o_custkey")})
    return E.settled(rows, ["running"]).select("o_orderkey", "running")


@Q.add("st08_reports_to_send", "SELECT event_id FROM (SELECT event_id, event_type, ts, lag(event_type) OVER w AS p, lag(ts) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE p IS NULL OR p <> event_type OR epoch(date_trunc('second', ts)) - epoch(date_trunc('second', pt)) >= 86400")
def reports_to_send(spark, sf):
    rows = table(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    from pyspark.sql.window import Window

    over = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(over))
    before = F.lag("event_type").over(over)
    return rows.withColumn("send", before.isNull() | (before != F.col("event_type")) | (gap >= 86400)).filter("send").select("event_id")


@Q.add("st12_reconcile_offline", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') AND o_custkey % 10 = 0 THEN 'cancelled' ELSE o_orderstatus END AS status FROM orders")
def reconcile_offline(spark, sf):
    dead = table(spark, sf, "customer").filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return E.reconcile_offline(table(spark, sf, "orders"), dead, "o_custkey", "o_orderstatus", ["O", "P"], "cancelled").select("o_orderkey", F.col("o_orderstatus").alias("status"))


@Q.add("st14_lease_totals", "SELECT l_suppkey AS model_id, count(*) FILTER (WHERE l_linestatus = 'O') - count(*) FILTER (WHERE l_linestatus <> 'O') AS running, count(*) FILTER (WHERE l_linestatus <> 'O' AND l_returnflag <> 'R') AS success, count(*) FILTER (WHERE l_linestatus <> 'O' AND l_returnflag = 'R') AS failed, CAST(sum(CASE WHEN l_linestatus <> 'O' THEN l_linenumber ELSE 0 END) AS BIGINT) AS duration_ms FROM lineitem GROUP BY l_suppkey")
def lease_totals(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("model_id"), F.when(F.col("l_linestatus") == "O", "acquire").otherwise("release").alias("kind"), F.when(F.col("l_returnflag") == "R", "failure").otherwise("success").alias("outcome"), F.col("l_linenumber").alias("duration_ms"))
    return E.lease_totals(rows)


@Q.add("st15_continuation", "SELECT o_custkey AS scan_id, greatest(count(*) - count(*) FILTER (WHERE o_orderstatus = 'O') * 2, 0) AS offset_ FROM orders GROUP BY o_custkey")
def continuation(spark, sf):
    scans = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("scan_id")).agg(F.count(F.lit(1)).alias("total"), (F.count_if(F.col("o_orderstatus") == "O") * 2).alias("remaining"))
    items = table(spark, sf, "lineitem").select("l_orderkey")
    return E.continuation(scans, items, items, ["l_orderkey"])[0].select("scan_id", F.col("offset").alias("offset_"))


@Q.add("st10_fold_view", "SELECT user_id, event_type, max_by(value, event_id) AS value, count(*) AS n FROM events GROUP BY user_id, event_type")
def fold_view(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.count(F.lit(1)).alias("n"))


@Q.add("dt01_minutes_and_windows", "SELECT event_id, hour(ts) * 60 + minute(ts) AS minutes, CASE WHEN isodow(ts) <= 5 THEN (hour(ts) * 60 + minute(ts) >= 1320 OR hour(ts) * 60 + minute(ts) < 360) ELSE FALSE END AS open FROM events")
def minutes_and_windows(spark, sf):
    from ..functions.text import in_time_window, minutes_of_day

    days = F.array(*[F.lit(d) for d in range(1, 6)])
    return table(spark, sf, "events").select("event_id", minutes_of_day(F.date_format("ts", "HH:mm")).cast("long").alias("minutes"), in_time_window(F.col("ts"), F.lit(1320), F.lit(360), days).alias("open"))
