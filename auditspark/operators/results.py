"""Operators over results: normalising, filling in, filtering, joining and ordering findings, tasks, scans and reviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import call_names, stable_id
from .candidates import keep_first
from .joins import ROWS, WIDE_ROWS, dealt


def filled(value: Column, default) -> Column:
    """The value, or the default where it is null or blank."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), default if isinstance(default, Column) else F.lit(default))


def normalised(findings: DataFrame) -> DataFrame:
    """``findings(line, ai_verdict, severity, confirmed)`` of a model with defaults filled in: a line of 1 at least, a verdict
    that says whether it is confirmed, an unknown severity."""
    verdict = F.when(F.coalesce("confirmed", F.lit(False)), "confirmed").otherwise("not_confirmed")
    line = F.greatest(F.lit(1), F.coalesce(F.col("line").cast("long"), F.lit(1)))
    return findings.withColumns({"line": line, "ai_verdict": filled(F.col("ai_verdict"), verdict), "severity": filled(F.col("severity"), "unknown")})


def with_fallback(candidates: DataFrame, results: DataFrame, key, timed_out: Column) -> DataFrame:
    """Every candidate with its result; one without is ``failed``, one whose run timed out ``timeout``, others ``ok``.

    results: one row a key. timed_out: a condition on a result's row.
    """
    found = results.withColumn("_late", F.coalesce(timed_out, F.lit(False)))
    joined = candidates.join(found, list(key), "left")
    return joined.withColumn("outcome", F.when(F.col("_late").isNull(), "failed").when(F.col("_late"), "timeout").otherwise("ok")).drop("_late")


def audit_status(verdict: Column) -> Column:
    """What a list shows: ``timeout``, ``waiting`` without a verdict, ``issue`` if confirmed, else ``clean``."""
    v = F.lower(F.trim(F.coalesce(verdict, F.lit(""))))
    return F.when(v == "timeout", "timeout").when(v == "", "waiting").when(v == "confirmed", "issue").otherwise("clean")


def metavar(name: str, metavars: str | dict[str, Column] = "metavars") -> Column:
    """The trimmed value of a metavariable; null if it is missing or blank. metavars: a map column, or the columns of such values."""
    return metavars[name] if isinstance(metavars, dict) else F.nullif(F.trim(F.col(metavars)[f"${name}"]), F.lit(""))


class Values(dict):
    """The columns ``_v_NAME`` that hold metavariables' values, by name, of those that expressions ask for."""

    def __missing__(self, name: str) -> Column:
        return self.setdefault(name, F.col(f"_v_{name}"))

    def taken(self) -> dict[str, Column]:
        """The values by the names of their columns, out of the map, so that each is looked up and trimmed once a row."""
        return {f"_v_{name}": metavar(name) for name in self}


def arithmetic(source: Column, metavars: str | dict[str, Column] = "metavars") -> Column:
    """The arithmetic that a match shows: as captured, else of two operands, a count and a size, or a length and an offset,
    with the operator that the rule's name tells; null if there is none."""
    v = lambda name: metavar(name, metavars)
    operator = F.when(source.contains("sub"), "-").when(source.contains("add") | source.contains("sum"), "+").when(source.contains("mul"), "*").otherwise("+/-/*")
    offset = F.when(source.contains("sub") | source.contains("header"), "-").otherwise("+")
    of = lambda a, op, b: F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit(" "), op, F.lit(" "), b))
    return F.coalesce(v("ARITH"), of(v("A"), operator, v("B")), of(v("COUNT"), F.lit("*"), v("SIZE")), of(v("LEN"), offset, v("OFF")))


def sink(metavars: str | dict[str, Column] = "metavars") -> Column:
    """Where a match uses the result: a call, an element, a pointer or a loop's bound; null if there is none."""
    v = lambda *names: F.coalesce(*[metavar(n, metavars) for n in names])
    return F.coalesce(F.concat(v("CALL"), F.lit("(...)")), F.concat(v("ARR", "BASE"), F.lit("["), v("IDX", "ARITH"), F.lit("]")), F.concat(F.lit("*("), v("PTR", "P"), F.lit(" +/- "), v("OFF", "ARITH"), F.lit(")")), F.concat(F.lit("loop bound "), v("BOUND")))


def memory_place(metavars: str | dict[str, Column] = "metavars") -> Column:
    """The memory that a loop's index reaches, from the most to the least telling form; null if there is none."""
    v = lambda *names: F.coalesce(*[metavar(n, metavars) for n in names])
    pointer = v("PTR", "P")
    of = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.coalesce(
        of(v("COPY"), "(", v("DST"), ", ..., ", v("LEN"), ")"), of(v("MEMFUNC"), "(...)"), of(v("BASE"), "[", v("IDX"), " +/- ", v("OFF"), "]"), of(v("BASE"), "[", v("IDX"), "]"),
        of("(", pointer, " +/- ", v("IDX"), ")->", v("FIELD")), of(pointer, "->", v("FIELD")), of("*(", pointer, " +/- ", v("IDX"), " +/- ", v("OFF"), ")"), of("*(", pointer, " +/- ", v("IDX"), ")"),
    )


def real_count(count: Column) -> Column:
    """A count of the index; zero and less mean that nothing was counted: null."""
    return F.when(count > 0, count)


def where_all(rows: DataFrame, conditions: list[Column | None]) -> DataFrame:
    """Rows that meet all conditions that are given."""
    given = [c for c in conditions if c is not None]
    return rows.filter(reduce(lambda a, b: a & b, given)) if given else rows


def static_candidates(rows: DataFrame) -> DataFrame:
    """``rows(vuln_type[, metadata map])`` without the placeholders of threat analysis."""
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    rows = rows.filter(plain(F.col("vuln_type")) != "threat_audit")
    return rows.filter(plain(F.col("metadata")["source"]) != "threat_analysis") if "metadata" in rows.columns else rows


def visible(rules: DataFrame, user: Column, admin: bool) -> DataFrame:
    """``rules(public, owner)`` that a user sees: public ones and their own; an administrator sees all."""
    return rules if admin else rules.filter(F.coalesce("public", F.lit(False)) | (F.col("owner") == user))


def listed(findings: DataFrame, severity: str | None = None, vuln_type: str | None = None, verdict: str | None = None, problem: bool | None = None) -> DataFrame:
    """Findings that a list's filters leave; a finding without a user's verdict is pending."""
    state = filled(F.col("user_verdict"), "pending")
    return where_all(findings, [None if severity is None else F.col("severity") == severity, None if vuln_type is None else F.col("vuln_type") == vuln_type, None if verdict is None else state == verdict, None if problem is None else F.coalesce("confirmed", F.lit(False)) == problem])


def in_phases(events: DataFrame, phases) -> DataFrame:
    return events.filter(F.col("phase").isin(*phases))


def references_of(references: DataFrame, files: DataFrame, functions: DataFrame) -> DataFrame:
    """``references(file_id, function_id)`` with their file, and the name of their function where it is known."""
    named = functions.select("function_id", F.col("name").alias("function_name"))
    return references.join(files, "file_id").join(named, "function_id", "left")


def of_project(findings: DataFrame, scans: DataFrame, project: str) -> DataFrame:
    return findings.join(scans.filter(F.col("project") == project).select("scan_id", "project"), "scan_id")


def reviews_of_jobs(reviews: DataFrame, jobs: DataFrame) -> DataFrame:
    """``reviews(job, ...)`` with their ``jobs(job, status, created_at)`` and their place within the job: the oldest first.

    Reviews are counted first; join and window share the partitions that follow from it.
    """
    return placed(dealt(reviews, ["job"], reviews.count(), ROWS).join(jobs, "job"), ["created_at", "seq"], ["job"])


def scans_with_users(scans: DataFrame, users: DataFrame) -> DataFrame:
    """Every scan; username is null where the user is gone."""
    return scans.join(users.select("user_id", "username"), "user_id", "left")


TREE = (
    "scan_id string, seq long, tree_id string, asset_name string, root_node_id string, nodes array<struct<node_id:string,node_name:string>>, "
    "attack_paths array<struct<path_id:string,path_name:string,path_description:string,related:array<struct<module_name:string,node_id:string,association:string>>,patterns:array<struct<pattern_id:string,pattern_name:string>>>>"
)


def tasks_of(trees: DataFrame, modules: DataFrame, total: int | None = None) -> DataFrame:
    """One task a pattern of each path of ``trees`` (see TREE), the first of each identity.

    modules(name, seq, threat, paths array<struct<path,description>>): of several with a name the last one counts; a path's
    modules are those its related names name, in order; code paths are theirs without repeats. Identity is tree, path,
    pattern and pattern name; ids that are missing are numbered by place. total: how many paths the trees have, else they
    are counted; what a task sorts is bounded by it.
    """
    total = trees.agg(F.sum(F.size(F.coalesce("attack_paths", F.array())).cast("long"))).first()[0] or 0 if total is None else total
    number = lambda prefix, at: F.concat(prefix, (at + 1).cast("string"))
    trees = trees.withColumn("tree_id", filled(F.col("tree_id"), number(F.lit("tree-"), F.col("seq"))))
    node_names = F.map_from_entries(F.transform(F.filter(F.coalesce("nodes", F.array()), lambda n: F.coalesce(n["node_id"], F.lit("")) != ""), lambda n: F.struct(n["node_id"], n["node_name"])))
    paths = trees.withColumn("node_names", F.when(F.size(F.coalesce("nodes", F.array())) > 0, node_names)).select("*", F.posexplode("attack_paths").alias("path_at", "p")).drop("attack_paths", "nodes")
    paths = paths.withColumn("path_id", filled(F.col("p.path_id"), number(F.concat("tree_id", F.lit("-path-")), F.col("path_at"))))
    # Modules by name: equal names of one scan's paths meet them by a join; only names and code paths are moved.
    known = keep_first(modules.withColumn("_name", F.trim("name")).filter("_name <> ''"), ["_name"], [F.desc("seq")]).select("_name", "threat", "paths")
    wanted = paths.select("scan_id", "tree_id", "seq", "path_at", F.posexplode(F.transform("p.related", lambda r: F.trim(r["module_name"]))).alias("at", "_name"))
    key = ["scan_id", "tree_id", "seq", "path_at"]
    matched = dealt(wanted.join(known, "_name"), key, total, WIDE_ROWS).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "threat", "paths"))).alias("m"))
    # The first description of each path stays.
    flat = F.flatten(F.transform("m", lambda x: F.coalesce(x["paths"], F.array())))
    first_of_each = F.filter(flat, lambda x, i: ~F.exists(F.slice(flat, F.lit(1), i), lambda y: y["path"] == x["path"]))
    risks = F.array_distinct(F.filter(F.transform("m", lambda x: F.trim(x["threat"])), lambda t: F.coalesce(t, F.lit("")) != ""))
    matched = matched.select(*key, first_of_each.alias("code_paths"), F.array_join(risks, "；").alias("risk_name"))
    paths = dealt(paths, key, total, WIDE_ROWS).join(matched, key, "left")
    surface = F.get("p.related", F.lit(0))
    patterns = paths.select("*", F.posexplode("p.patterns").alias("pattern_at", "pattern"))
    patterns = patterns.withColumns({
        "pattern_id": filled(F.col("pattern.pattern_id"), number(F.concat("path_id", F.lit("-pattern-")), F.col("pattern_at"))),
        "method_name": filled(F.col("pattern.pattern_name"), "unnamed pattern"),
        "surface_name": filled(F.coalesce(F.nullif(F.trim(surface["module_name"]), F.lit("")), F.try_element_at("node_names", surface["node_id"])), "unnamed module"),
        "attack_goal": filled(F.coalesce(F.nullif(F.trim("p.path_name"), F.lit("")), F.try_element_at("node_names", F.col("root_node_id"))), "unnamed goal"),
        "asset": filled(F.col("asset_name"), "unnamed asset"), "risk": filled(F.col("risk_name"), "unnamed risk"),
        "evidence": F.filter(F.concat(F.array(F.trim("p.path_description")), F.transform("p.related", lambda r: F.trim(r["association"]))), lambda e: F.coalesce(e, F.lit("")) != ""),
    })
    identity = F.concat_ws("\0", "tree_id", "path_id", "pattern_id", "method_name")
    patterns = patterns.withColumn("identity", identity)
    # Where patterns are dealt, no rank limit comes before the shuffle: a path's own repeats go where they are.
    own = keep_first(patterns, [*key, "identity"], ["pattern_at"])
    spread = dealt(own, ["scan_id", "identity"], total, WIDE_ROWS)
    patterns = keep_first(patterns if spread is own else spread, ["scan_id", "identity"], ["seq", "path_at", "pattern_at"])
    first = F.get("code_paths", F.lit(0))
    return patterns.select(
        "scan_id", stable_id(F.col("scan_id"), F.col("identity")).alias("task_id"), F.sha1("identity").alias("fingerprint"), "tree_id", F.col("path_id").alias("attack_path_id"), "pattern_id", "method_name", "surface_name", "attack_goal",
        F.col("asset").alias("asset_name"), F.col("risk").alias("risk_name"), F.coalesce(first["path"], F.lit("")).alias("code_path"), F.coalesce("code_paths", F.array().cast("array<struct<path:string,description:string>>")).alias("code_paths"), "evidence",
    )


def label_or_id(name: Column, ident: Column, generated: str = r"(?i)^(?:node|path|tree|asset)[-_ ]?\d+$") -> Column:
    """The name, unless it is blank or only a generated id: then one made of the id."""
    plain = F.trim(F.coalesce(name, F.lit("")))
    return F.when((plain == "") | plain.rlike(generated), F.concat(F.lit("module "), ident.cast("string"))).otherwise(plain)


def dangling(used: DataFrame, nodes: DataFrame, key: str = "node_id") -> DataFrame:
    """Distinct keys in use that no node has: must be empty."""
    return used.filter(F.col(key).isNotNull()).select(key).distinct().join(nodes.select(key), key, "left_anti")


def findings_of_tasks(tasks: DataFrame, findings: DataFrame) -> DataFrame:
    """Each task with the sorted indexes of its ``findings(source_task_id, idx)``; empty where there are none."""
    own = findings.groupBy(F.col("source_task_id").alias("task_id")).agg(F.array_sort(F.collect_list("idx")).alias("finding_ids"))
    joined = tasks.join(own, "task_id", "left")
    return joined.withColumn("finding_ids", F.coalesce("finding_ids", F.array().cast(joined.schema["finding_ids"].dataType)))


def progress_of_jobs(candidates: DataFrame, results: DataFrame, job: str, key) -> DataFrame:
    """``(job, total, done)``: a job's candidates, and those of them that have a result."""
    done = results.select(*key).distinct().withColumn("_done", F.lit(1))
    return candidates.join(done, list(key), "left").groupBy(job).agg(F.count(F.lit(1)).alias("total"), F.count("_done").alias("done"))


def open_tasks(tasks: DataFrame, scan: str = "scan_id", status: str = "status", done: str = "completed") -> DataFrame:
    """``(scan, n)``: tasks that are not completed; scans without any have no row. A null status is open."""
    return tasks.filter(F.coalesce(F.col(status), F.lit("")) != done).groupBy(scan).agg(F.count(F.lit(1)).alias("n"))


def tickets_per_checker(findings: DataFrame) -> DataFrame:
    return findings.groupBy("vuln_type").agg(F.count_if("ticket_submitted").alias("n"))


def duration_total(average: Column, completed: Column) -> Column:
    """The total from which an average over completed runs was made; null where nothing was completed."""
    return F.when(completed > 0, average * completed)


def pool_totals(models: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row: running and queued of all ``models(running, queued)``, and completed ``tasks(status, model_id)`` that no
    model is named for."""
    sums = models.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("running", "queued")])
    loose = tasks.agg(F.count_if((F.col("status") == "completed") & (filled(F.col("model_id").cast("string"), "") == "")).alias("unassigned"))
    # One row each.
    return sums.join(loose, F.lit(True))


def options(rows: DataFrame, column: str) -> DataFrame:
    """Distinct values that are not blank, sorted."""
    return rows.select(F.trim(column).alias("option")).filter("option <> ''").distinct().orderBy("option")


def grouped_by_title(artifacts: DataFrame, order: str) -> DataFrame:
    """``(title, place, n)`` of trimmed titles in the order of their first artifact."""
    return artifacts.groupBy(F.trim("title").alias("title")).agg(F.min(order).alias("place"), F.count(F.lit(1)).alias("n")).orderBy("place")


def progress_samples(rows: DataFrame, key, order, step: int = 100) -> DataFrame:
    """Every ``step``-th row of a key and its last one, with done and total."""
    numbered = placed(rows, order, key, "done")
    total = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("total"))
    return numbered.join(total, list(key)).filter((F.col("done") % step == 0) | (F.col("done") == F.col("total")))


def placed(rows: DataFrame, order, within, name: str = "place") -> DataFrame:
    """``rows`` with their place, from 1, in the order within each key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)).cast("long"))


def newest_first(created: str, ident: str) -> list[Column]:
    return [F.desc_nulls_last(created), F.col(ident).asc()]


def checker_order(user_created: str, scan_count: str, name: str) -> list[Column]:
    """The engine's own rules first, then those in use, then by name."""
    return [F.coalesce(F.col(user_created), F.lit(False)).asc(), (F.coalesce(F.col(scan_count), F.lit(0)) == 0).asc(), F.col(name).asc()]


def catalog_order(user_created: str, modified: str, ident: str) -> list[Column]:
    return [F.coalesce(F.col(user_created), F.lit(False)).asc(), F.desc_nulls_last(modified), F.col(ident).asc()]


def audit_order(audit_index: str, idx: str) -> list[Column]:
    """By the index of the audit, by their own where they were not audited."""
    return [F.coalesce(F.col(audit_index), F.col(idx)).asc(), F.col(idx).asc()]


def rank_order(column: str, ranked: list[str], ident: str) -> list[Column]:
    """By place in the list, others last."""
    rank = reduce(lambda c, x: c.when(F.col(column) == x[1], x[0]), enumerate(ranked[1:], 1), F.when(F.col(column) == ranked[0], 0))
    return [rank.otherwise(len(ranked)).asc(), F.col(ident).asc()]


def scheduler_order(priority: str, sequence: str) -> list[Column]:
    return [F.desc(priority), F.col(sequence).asc()]


def unreviewed_first(verdict: str, idx: str) -> list[Column]:
    return [F.col(verdict).isNotNull().asc(), F.col(idx).asc()]


def capped(values: Column, limit: int = 12) -> Column:
    """An aggregate: the first distinct values in order."""
    return F.slice(F.array_sort(F.collect_set(values)), 1, limit)


def union_of_names(parts: list[DataFrame], name: str = "name") -> DataFrame:
    return reduce(DataFrame.unionAll, [p.select(name) for p in parts]).distinct()


def calling_any(functions: DataFrame, names: DataFrame) -> DataFrame:
    """Functions whose body calls one of ``names(name)``: calls as rows, so the names need not be sent to all tasks."""
    calls = functions.select("function_id", F.explode(F.array_distinct(call_names(F.col("body")))).alias("_call"))
    hit = calls.join(names.select(F.col("name").alias("_call")).distinct(), "_call", "left_semi").select("function_id").distinct()
    return functions.join(hit, "function_id", "left_semi")


def encoded(columns: list[str]) -> Column:
    """The columns as one JSON object, with text as it is and nulls left in."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def replay(events: DataFrame, scan: str, after: Column | int = -1) -> DataFrame:
    """A scan's events after a sequence number with their place in order; an event stored twice counts once."""
    later = keep_first(events.filter(F.col("seq") > after), [scan, "seq"], ["seq"])
    return placed(later, ["seq"], [scan])
