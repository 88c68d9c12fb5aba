"""Analytics over findings and their reviews: issue metrics, scan lists, checker dashboards, pool statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .candidates import keep_first

NO_RESULT = "no result"


def ratio(numerator: Column, denominator: Column, digits: int = 4) -> Column:
    """Null where the denominator is not positive."""
    return F.when(denominator > 0, F.round(numerator / denominator, digits))


def is_llm_issue(verdict: Column, confirmed: Column) -> Column:
    """The verdict decides if there is one, else the flag."""
    set_ = F.nullif(verdict, F.lit(""))
    return F.coalesce(F.when(set_.isNotNull(), set_ == "confirmed").otherwise(confirmed), F.lit(False))


def latest_reviews(reviews: DataFrame, key, order) -> DataFrame:
    """The latest review of each finding among actual conclusions."""
    effective = F.col("verdict").isin("tp", "fp") & ~F.coalesce(F.col("reason"), F.lit("")).startswith(NO_RESULT)
    return keep_first(reviews.filter(effective), key, [F.desc(c) for c in order])


def issue_counts() -> list[Column]:
    """The counters, over findings with columns ai_verdict, confirmed, user_verdict and review_verdict (null: none)."""
    llm = is_llm_issue(F.col("ai_verdict"), F.col("confirmed"))
    tp, fp = F.col("review_verdict") == "tp", F.col("review_verdict") == "fp"
    return [
        F.count(F.lit(1)).alias("static_issue_count"),
        F.count_if(llm).alias("llm_issue_count"),
        F.count_if(tp).alias("fp_review_issue_count"),
        F.count_if(fp).alias("fp_review_false_positive_count"),
        F.count_if(F.col("user_verdict") == "confirmed").alias("human_confirmed_count"),
        F.count_if(F.col("user_verdict") == "false_positive").alias("human_false_positive_count"),
        F.count_if(tp | (F.col("review_verdict").isNull() & llm)).alias("accuracy_basis_count"),
    ]


def issue_metrics(findings: DataFrame, by: list[str], checker: str | None = None) -> DataFrame:
    if checker is not None:
        findings = findings.filter(F.col("vuln_type") == checker)
    counted = findings.groupBy(*by).agg(*issue_counts())
    return counted.withColumn("effective_issue_count", F.col("llm_issue_count") - F.col("fp_review_false_positive_count")).withColumn("accuracy", ratio(F.col("human_confirmed_count"), F.col("accuracy_basis_count")))


def reviewed(findings: DataFrame, latest: DataFrame, key) -> DataFrame:
    return findings.join(latest.select(*key, F.col("verdict").alias("review_verdict")), list(key), "left")


def count_per(parents: DataFrame, children: DataFrame, key: str, name: str = "n", where: Column | None = None) -> DataFrame:
    """Parents with how many children they have, zero included; children are counted before the join."""
    counted = (children if where is None else children.filter(where)).groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return parents.join(counted, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def checker_dashboard(checkers: DataFrame, scans: DataFrame, findings: DataFrame, product: str | None = None, unconfigured: str = "__unconfigured__") -> DataFrame:
    """One row a checker, also those without scans: scans and projects that used it, issue counters, accuracies.

    checkers(checker, user_created); scans(scan_id, project, product, scan_items array); findings(scan_id, vuln_type,
    review_verdict, ticket_submitted, ...).
    """
    if product == unconfigured:
        scans = scans.filter(F.coalesce("product", F.lit("")) == "")
    elif product:
        scans = scans.filter(F.col("product") == product)
    used = scans.select("scan_id", "project", F.explode(F.array_distinct("scan_items")).alias("checker"))
    per_scan = used.groupBy("checker").agg(F.count(F.lit(1)).alias("scan_count"), F.count_distinct(F.nullif("project", F.lit(""))).alias("project_count"))
    own = findings.join(used.select("scan_id", F.col("checker").alias("vuln_type")), ["scan_id", "vuln_type"], "left_semi")
    counts = own.groupBy(F.col("vuln_type").alias("checker")).agg(*issue_counts(), F.count_if("ticket_submitted").alias("ticket_submitted_count"))
    names = checkers.select("checker", "user_created").join(per_scan, "checker", "full").join(counts, "checker", "left")
    numbers = [c for c in names.columns if c.endswith("_count")]
    names = names.select("checker", F.coalesce("user_created", F.lit(False)).alias("user_created"), *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])
    basis = F.col("accuracy_basis_count")
    return names.withColumns({"accuracy": ratio(F.col("human_confirmed_count"), basis), "ticket_accuracy": ratio(F.col("ticket_submitted_count"), basis)}).orderBy("user_created", F.col("scan_count") == 0, "checker")


def effective_count(llm: Column, reviewed_fp: Column) -> Column:
    """Issues less those that a review called false; these need not be issues of the model, so it may be negative."""
    return llm - reviewed_fp


def dashboard_summary(dashboard: DataFrame) -> DataFrame:
    """Totals over built-in checkers."""
    own = dashboard.filter(~F.col("user_created"))
    total = own.agg(F.count(F.lit(1)).alias("checker_count"), *[F.sum(c).alias(c) for c in ("static_issue_count", "llm_issue_count", "fp_review_false_positive_count", "human_confirmed_count", "ticket_submitted_count", "accuracy_basis_count")])
    return total.withColumn("total_issue_count", effective_count(F.col("llm_issue_count"), F.col("fp_review_false_positive_count"))).withColumn("accuracy", ratio(F.col("human_confirmed_count"), F.col("accuracy_basis_count")))


def pool_stats(leases: DataFrame, key=("model_id",)) -> DataFrame:
    """Sums over sessions, the last label that is not empty, and the mean duration of what completed."""
    last = F.max_by(F.nullif("label", F.lit("")), F.when(F.nullif("label", F.lit("")).isNotNull(), F.struct("updated_at", "session_id")))
    out = leases.groupBy(*key).agg(F.sum("total").alias("total"), F.sum("success").alias("success"), F.sum("failed").alias("failed"), F.sum("duration_ms").alias("duration_ms"), last.alias("label"))
    done = F.col("success") + F.col("failed")
    return out.withColumn("avg_ms", F.when(done > 0, F.round(F.col("duration_ms") / done, 2)).otherwise(0.0))


def facet_counts(rows: DataFrame, facet: str, labels: DataFrame | None = None) -> DataFrame:
    """Rows a value, by label; with labels also those that do not occur."""
    counted = rows.groupBy(facet).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(facet) if labels is None else labels.join(counted, facet, "left").select(facet, F.coalesce("n", F.lit(0)).alias("n")).orderBy(facet)


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.round(100 * done / total)))).otherwise(0.0)


def ordered_text(value: Column, order: Column, joiner: str = "\n") -> Column:
    """An aggregate: values that are not blank, joined in order."""
    kept = F.collect_list(F.when(F.trim(value) != "", F.struct(order.alias("o"), value.alias("v"))))
    return F.array_join(F.transform(F.array_sort(kept), lambda x: x["v"]), joiner)


def distinct_text(value: Column, order: Column, joiner: str = "；") -> Column:
    """An aggregate: distinct values in first-seen order, joined."""
    kept = F.collect_list(F.struct(order.alias("o"), value.alias("v")))
    return F.array_join(F.array_distinct(F.transform(F.array_sort(kept), lambda x: x["v"])), joiner)


def running_max(value: str, key, order) -> Column:
    return F.max(value).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def page(rows: DataFrame, order, number: int, size: int = 20) -> DataFrame:
    """A page of rows in order; a number past the end is the last page."""
    last = max(1, -(-rows.count() // size))
    return rows.orderBy(*order).offset((min(max(1, number), last) - 1) * size).limit(size)


def last_per_key(rows: DataFrame, key, order, n: int) -> DataFrame:
    over = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(over)).filter(F.col("_n") <= n).drop("_n")


def capacity(models: DataFrame, limit: int) -> DataFrame:
    """Concurrency of the eligible models together, at most ``limit``."""
    return models.filter("eligible").agg(F.least(F.coalesce(F.sum("max_concurrency"), F.lit(0)), F.lit(limit)).alias("capacity"))
