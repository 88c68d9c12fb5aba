"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are first summed by membership pattern (the set of sources that a document belongs to), so the flow problem has
one node a pattern, not one a document. A pattern offers its words once at cost 0, a second time at cost 1, and so on up
to ``max_repeats``: a convex cost, so the flow repeats text only where fresh text is used up. Sources take up to their
target. The flow's words for each pattern are then dealt to its documents in a seeded order.

Defined results: a null text has size 0; a null source is a source of its own, last in order; repeated rows are documents
of their own; an empty table gives an empty result; columns of the input that the result has too are replaced. Documents
that tie in the seeded order follow by id, then size. At most one document of a pattern is taken in part in each repeat.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, column_or_null, materialize

WEIGHTS = (5, 2, 1)
#: Patterns are summed up before they reach the driver. Beyond this many the job stops with an error: the flow has one node
#: a pattern, and a part of them would not give the least cost.
MAX_PATTERNS = 2_000_000
BINS = 4096


def source_targets(sizes: list[int], share: float = 1.5, weights=WEIGHTS, cap: float = 2.0) -> list[float]:
    """Targets of the sources in their order: shares of ``share`` of all words by repeating weights, none above ``cap``
    times its source's size; what is above goes to the others by weight until none is above."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    target, left = [0.0] * len(sizes), share * sum(sizes)
    free = [i for i in range(len(sizes)) if sizes[i] > 0]
    while free:
        total = sum(weight[i] for i in free)
        full = [i for i in free if left * weight[i] / total > cap * sizes[i]]
        if not full:
            for i in free:
                target[i] = left * weight[i] / total
            break
        for i in full:
            target[i] = cap * sizes[i]
        left -= sum(target[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return target


def min_cost_flow(supply: list[int], members: list[list[int]], quota: list[int], max_repeats: int) -> list[dict[int, int]]:
    """Words that each pattern gives to each source: a maximum flow of least cost.

    supply: words of each pattern; members: its sources; quota: words that each source takes. Successive shortest paths:
    the r-th use of a pattern costs r, so flow is added level by level, each level being a maximum flow that may reroute
    what earlier levels placed. Costs depend on the pattern's level only, which makes the greedy levels optimal.

    Paths run over sources, of which there are few: for each pair of sources the patterns that send words to the one and
    could send them to the other are kept, so a search looks at pairs, not at patterns.
    """
    flow: list[dict[int, int]] = [dict() for _ in supply]
    # movable[s][t]: patterns that send to s and are members of t (a dict keeps their order).
    movable: list[dict[int, dict[int, None]]] = [{} for _ in quota]
    left, quota = [0] * len(supply), list(quota)

    def send(p: int, s: int, amount: int) -> None:
        had = flow[p].get(s, 0)
        flow[p][s] = had + amount
        if not flow[p][s]:
            del flow[p][s]
        if bool(had) != bool(had + amount):
            for t in members[p]:
                if t != s:
                    of = movable[s].setdefault(t, {})
                    if had:
                        del of[p]
                        if not of:
                            del movable[s][t]
                    else:
                        of[p] = None

    for _ in range(max_repeats):
        left = [a + b for a, b in zip(left, supply, strict=True)]
        # Rarest memberships first leaves the least to reroute; the result is the same.
        for p in sorted(range(len(supply)), key=lambda p: (len(members[p]), p)):
            while left[p] > 0 and (path := _augmenting(members[p], quota, movable)):
                moves = [(next(iter(movable[s][t])), s, t) for s, t in zip(path, path[1:])]
                amount = min(left[p], quota[path[-1]], *(flow[q][s] for q, s, _ in moves))
                for q, s, t in moves:
                    send(q, s, -amount)
                    send(q, t, amount)
                send(p, path[0], amount)
                left[p] -= amount
                quota[path[-1]] -= amount
        if not any(quota):
            break
    return flow


def _augmenting(starts: list[int], quota: list[int], movable: list[dict[int, dict[int, None]]]) -> list[int] | None:
    """Shortest list of sources from one of the starts to one with quota left, each giving up words to be sent to the next."""
    came: dict[int, int | None] = dict.fromkeys(starts)
    queue = deque(starts)
    while queue:
        s = queue.popleft()
        if quota[s] > 0:
            path = [s]
            while (before := came[path[-1]]) is not None:
                path.append(before)
            return path[::-1]
        for t in sorted(movable[s]):
            if t not in came:
                came[t] = s
                queue.append(t)
    return None


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, sources: Column, size: Column | None = None, share: float = 1.5, weights=WEIGHTS, max_repeats: int = 2, seed: int = 17, content: Column | None = None) -> DataFrame:
    """``docs`` with size, pattern_size, source_size, target and taken (words of the document that the mix takes).

    sources: an array column, the sources that a document belongs to; source_size and target are those of its first. content:
    what the seeded order tells documents apart by, beside their id; by default a hash of the text.
    """
    spark = docs.sparkSession
    docs = docs.drop("pattern_size", "source_size", "target", "taken")
    in_order = F.array_sort(sources, lambda a, b: F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), 1).when(b.isNull(), -1).when(a < b, -1).when(a > b, 1).otherwise(0))
    order = F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text") if content is None else content)
    # The document's own columns travel as one, so their names meet none of those below.
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_docs"), F.col("doc_id").alias("_id"), in_order.alias("_pattern"), F.get(sources, F.lit(0)).alias("_first"), (word_count(F.col("text")) if size is None else size).alias("size"), order.alias("_order"))
    # By pattern and by bin of the seeded order: sums that are combined before the shuffle.
    bins = materialize(rows.groupBy("_pattern", F.pmod("_order", F.lit(BINS)).alias("_bin")).agg(F.sum("size").alias("words")), "mix-bins")
    totals = bins.groupBy("_pattern").agg(F.sum("words").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    names = sorted({s for r in totals for s in r["_pattern"]}, key=lambda s: (s is None, s or ""))
    index = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for r in totals:
        for s in set(r["_pattern"]):
            sizes[index[s]] += r["words"]
    targets = source_targets(sizes, share, weights)
    members = [sorted({index[s] for s in r["_pattern"]}) for r in totals]
    flow = min_cost_flow([r["words"] for r in totals], members, [round(t) for t in targets], max_repeats)
    # As many rows as patterns and sources, both checked above.
    pattern = T.ArrayType(T.StringType())
    plan = spark.createDataFrame([(list(r["_pattern"]), r["words"], sum(f.values())) for r, f in zip(totals, flow, strict=True)], T.StructType([T.StructField("_p", pattern), T.StructField("pattern_size", T.LongType()), T.StructField("_allotted", T.LongType())]))
    goal = spark.createDataFrame([(s, sizes[i], float(targets[i])) for s, i in index.items()], "_s string, source_size long, target double")
    over = Window.partitionBy("_pattern").orderBy("_bin")
    bounds = bins.join(F.broadcast(plan), F.col("_pattern").eqNullSafe(F.col("_p"))).withColumn("_before", F.sum("words").over(over) - F.col("words"))
    # Each repeat but the last takes all; the last takes documents in order until the rest of the allotment is used up.
    rest = F.when(F.col("pattern_size") > 0, F.col("_allotted") - F.col("pattern_size") * F.floor(F.col("_allotted") / F.col("pattern_size"))).otherwise(0)
    bounds = bounds.select("_pattern", "_bin", "_allotted", "pattern_size", (rest - F.col("_before")).alias("_room"), "words")
    step = F.pmod("_order", F.lit(BINS))
    cut = bounds.groupBy("_pattern").agg(F.first("_allotted").alias("_allotted"), F.first("pattern_size").alias("pattern_size"), F.coalesce(F.max(F.when(F.col("_room") >= F.col("words"), F.col("_bin"))), F.lit(-1)).alias("_full"), F.max(F.when((F.col("_room") > 0) & (F.col("_room") < F.col("words")), F.struct("_bin", "_room"))).alias("_edge"))
    cut = F.broadcast(cut.withColumnRenamed("_pattern", "_p"))
    rows = rows.join(cut, F.col("_pattern").eqNullSafe(F.col("_p"))).join(F.broadcast(goal), F.col("_first").eqNullSafe(F.col("_s")) & (F.size("_pattern") > 0), "left").withColumn("_bin", step)
    whole = F.when(F.col("pattern_size") > 0, F.floor(F.col("_allotted") / F.col("pattern_size"))).otherwise(0) * F.col("size")
    at_edge = F.col("_edge").isNotNull() & (F.col("_bin") == F.col("_edge._bin"))
    plain = rows.filter(~at_edge).withColumn("taken", (whole + F.when(F.col("_bin") <= F.col("_full"), F.col("size")).otherwise(0)).cast("long"))
    # One bin of each pattern is cut: its documents, one in BINS, are ordered within it.
    inside = Window.partitionBy("_pattern", "_bin").orderBy("_order", "_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cutting = rows.filter(at_edge).withColumn("_before", F.sum("size").over(inside) - F.col("size"))
    cutting = cutting.withColumn("taken", (whole + F.greatest(F.lit(0), F.least(F.col("size"), F.col("_edge._room") - F.col("_before")))).cast("long"))
    return plain.unionByName(cutting.drop("_before")).select(*[F.col("_docs")[c].alias(c) for c in docs.columns if c != "size"], "size", "pattern_size", "source_size", "target", "taken")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = column_or_null(docs, "text", "string")
    # Words are counted once; what follows reads ids, sources and sizes only.
    rows = docs.select(column_or_null(docs, "doc_id", "long").alias("doc_id"), column_or_null(docs, "source", "string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("content"))
    return mix(materialize(rows, "mix-sizes"), F.array("source"), F.col("size"), content=F.col("content")).select("doc_id", "source", "size", "source_size", "target", "taken")
