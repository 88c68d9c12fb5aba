"""Candidate algebra: first-seen dedup, resume, continuation, same-pattern suppression, unions and routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import CANDIDATE_KEY
from .joins import join_fact

RETRYABLE = ("timeout", "error", "failed", "cancelled")


def keep_first(rows: DataFrame, key, order) -> DataFrame:
    """The first row of each key. The rank limit is pushed below the shuffle, so a hot key sends one row a task."""
    over = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(over)).filter("_n = 1").drop("_n")


def keep_last(rows: DataFrame, key, order) -> DataFrame:
    return keep_first(rows, key, [F.desc(c) if isinstance(c, str) else c.desc() for c in order])


def merge_families(candidates: DataFrame, order) -> DataFrame:
    """One row a (family, file, function): the first, with the numbers of those merged into it."""
    key = ("family", "file", "function")
    merged = candidates.groupBy(*key).agg(F.array_sort(F.collect_set("seq")).alias("merged_from"))
    return keep_first(candidates, key, order).join(merged, list(key))


def without_processed(candidates: DataFrame, processed: DataFrame, key=CANDIDATE_KEY) -> DataFrame:
    return candidates.join(processed, list(key), "left_anti")


def continuable(stored: DataFrame, processed: DataFrame, retries: DataFrame, key=CANDIDATE_KEY, order=("seq",)) -> DataFrame:
    """What a scan goes on with: stored candidates that are not processed yet, the first of each key, and ``retries`` (rows
    of results that may be retried) of other keys.

    A retry stands as the last stored candidate of its key, or as itself, the first of its key, where none is stored.
    Placeholders of threat analysis among the stored candidates are left out.
    """
    from .results import static_candidates

    key, stored = list(key), static_candidates(stored)
    open_ = keep_first(without_processed(stored, processed, key), key, order)
    again = keep_first(retries, key, order).join(open_.select(*key), key, "left_anti")
    known = keep_last(stored.join(again.select(*key), key, "left_semi"), key, order)
    new = again.join(known.select(*key), key, "left_anti")
    return open_.unionByName(known).unionByName(new, allowMissingColumns=True)


def retryable(verdict: Column) -> Column:
    return F.coalesce(verdict, F.lit("")).isin(*RETRYABLE, "")


def pattern_of(scope: str, vuln_type: str = "vuln_type", function: str = "function", file: str = "file") -> list[str]:
    """Columns of the pattern: by function (also for an unknown scope), by file, or by type alone."""
    return {"file": [vuln_type, file], "project": [vuln_type]}.get(scope, [vuln_type, function])


def suppressed(candidates: DataFrame, pattern, rejected: Column, order: str = "seq") -> DataFrame:
    """``candidates`` with suppressed: a row earlier in ``order`` of the same pattern was rejected.

    The least rejected place of each pattern is a grouped minimum that is combined before the shuffle. It comes to the rows of
    a hot pattern by a broadcast, so a pattern of a third of all rows is never gathered.
    """
    first = candidates.filter(rejected).groupBy(*pattern).agg(F.min(order).alias("_first"))
    joined = join_fact(candidates, first, list(pattern), candidates.count())
    return joined.withColumn("suppressed", F.coalesce(F.col(order) > F.col("_first"), F.lit(False))).drop("_first")


def rejects_pattern(results: DataFrame, key=CANDIDATE_KEY) -> DataFrame:
    """Whether all results of a candidate, at least one, are unconfirmed with verdict ``not_confirmed``."""
    no = ~F.col("confirmed") & (F.col("ai_verdict") == "not_confirmed")
    return results.groupBy(*key).agg(F.bool_and(F.coalesce(no, F.lit(False))).alias("rejects"))


def concatenate(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def difference(rows: DataFrame, *others: DataFrame) -> DataFrame:
    """Distinct rows that none of the others has."""
    return reduce(DataFrame.subtract, others, rows)


def unknown_names(selected: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """Selected names that are not known: must be empty."""
    return selected.select(name).distinct().join(known.select(name), name, "left_anti")


def require_empty(rows: DataFrame, what: str) -> None:
    if found := rows.take(5):
        raise ValueError(f"{what}: {[tuple(r) for r in found]}")


def dense_index(rows: DataFrame, key, order, start: int = 0) -> DataFrame:
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1 + start)


def next_index(stored: DataFrame, key) -> DataFrame:
    return stored.groupBy(*key).agg((F.coalesce(F.max("idx"), F.lit(-1)) + 1).alias("next_idx"))


def upsert(stored: DataFrame, changes: DataFrame, key, order: str = "seq") -> DataFrame:
    """Stored rows with changes of the same key in their place: the latest by ``order`` wins, changes over stored."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return keep_first(both, key, [F.desc("_new"), F.desc(order)]).drop("_new")


def merge_in_place(rows: DataFrame, key, order: str = "seq") -> DataFrame:
    """Later rows of a key replace earlier ones at the place of the first: columns place and the latest row's own."""
    place = rows.groupBy(*key).agg(F.min(order).alias("place"))
    return keep_first(rows, key, [F.desc(order)]).join(place, list(key))


def duplicated_keys(rows: DataFrame, key) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def route_results(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """``candidates(candidate_id)`` with outcome: allocator, deallocator, rejected or unresolved; the last result of an id
    counts; missing or invalid ones are unresolved."""
    last = keep_first(results, ["candidate_id"], [F.desc("seq")])
    outcome = F.when(F.col("is_memory_api").isNull() | F.col("role").isNull(), "unresolved").when(~F.col("is_memory_api"), "rejected").when(F.col("role") == "alloc", "allocator").when(F.col("role") == "free", "deallocator").otherwise("unresolved")
    return candidates.join(last, "candidate_id", "left").withColumn("outcome", outcome)


def batches(rows: DataFrame, key, order, size: int) -> DataFrame:
    over = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("batch", F.floor((F.row_number().over(over) - 1) / size).cast("long"))


def resume_tasks(tasks: DataFrame, stored: DataFrame, key: str = "task_id") -> tuple[DataFrame, DataFrame]:
    """``tasks(position, task_id, ...)`` against ``stored(task_id, output)``: those whose stored output is JSON, with it, and
    those that are to run. Of several outputs of a task the greatest text counts, so that reruns agree."""
    good = stored.filter(F.expr("try_parse_json(output) IS NOT NULL")).groupBy(key).agg(F.max("output").alias("output"))
    return tasks.join(good, key), tasks.join(good.select(key), key, "left_anti")


def restored(reused: DataFrame, pending: DataFrame, results: DataFrame, key: str = "task_id") -> DataFrame:
    """All outputs at the positions of their tasks: stored ones (``reused``), and ``results(task_id, output)`` of what was
    pending; tasks without a result are left out. ``resumed`` tells which output was stored."""
    ran = pending.join(results.groupBy(key).agg(F.max("output").alias("output")), key).withColumn("resumed", F.lit(False))
    return reused.withColumn("resumed", F.lit(True)).unionByName(ran)
