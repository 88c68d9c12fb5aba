"""Lookups over the code index: names, paths, scopes, call edges, and the function that holds a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import escape_like, normal_path, short_name
from .joins import join_fact

#: A dimension whose plan is estimated at no more bytes than this is sent to all tasks; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if the optimizer's estimate of its size, which files bound, is at most ``most`` bytes."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= most else df


def with_files(entities: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    """Entities with the columns of their file."""
    return entities.join(files, key)


def by_name(functions: DataFrame, name: str) -> DataFrame:
    return functions.filter(F.col("name") == name)


def name_matches(name: Column, wanted: Column | str) -> Column:
    """Equal, or the last part after ``::`` in either case of ASCII letters."""
    wanted = F.lit(wanted) if isinstance(wanted, str) else wanted
    return (name == wanted) | F.lower(name).like(F.concat(F.lit("%::"), F.lower(escape_like(wanted))))


def by_short_name(functions: DataFrame, wanted: str) -> DataFrame:
    """Exact matches first, then by path and line."""
    pattern = "%::" + wanted.lower().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    found = functions.filter((F.col("name") == wanted) | F.lower("name").like(pattern))
    return found.orderBy(F.when(F.col("name") == wanted, 0).otherwise(1), "file_path", "start_line")


def by_short_names(functions: DataFrame, requests: DataFrame) -> DataFrame:
    """As by_short_name for many ``requests(request)`` at once, by two joins on a name, with the place of each function among
    those of a request."""
    named = functions.withColumn("_short", F.lower(short_name(F.col("name"))))
    asked = requests.select("request").distinct()
    exact = named.join(asked, F.col("name") == F.col("request"))
    suffix = named.filter(F.col("name").contains("::")).join(asked, F.col("_short") == F.lower("request")).filter(F.col("name") != F.col("request"))
    order = Window.partitionBy("request").orderBy(F.when(F.col("name") == F.col("request"), 0).otherwise(1), "file_path", "start_line", "function_id")
    return exact.unionByName(suffix).withColumn("place", F.row_number().over(order).cast("long")).drop("_short")


def resolve_names(requests: DataFrame, functions: DataFrame) -> DataFrame:
    """Functions for each row of ``requests(request)``, from the best tier that has any.

    Tier 0: the name itself. Tier 1, for a qualified request: functions of its short name whose signature or body holds
    the request. Tier 2, for an unqualified one: names that end in ``::request``. Each tier is an equi-join on a key.
    """
    asked = requests.select("request").distinct().withColumn("short", short_name(F.col("request"))).withColumn("qualified", F.col("request").contains("::"))
    named = functions.withColumn("_short", F.lower(short_name(F.col("name"))))
    exact = asked.join(named, F.col("request") == F.col("name")).withColumn("tier", F.lit(0))
    holds = F.coalesce(F.col("signature").contains(F.col("request")), F.lit(False)) | F.coalesce(F.col("body").contains(F.col("request")), F.lit(False))
    qualified = asked.filter("qualified").join(named, F.col("short") == F.col("name")).filter(holds).withColumn("tier", F.lit(1))
    suffix = asked.filter("not qualified").join(named, F.lower("request") == F.col("_short")).filter(F.col("name").contains("::")).withColumn("tier", F.lit(2))
    found = exact.unionByName(qualified).unionByName(suffix)
    best = found.withColumn("_best", F.min("tier").over(Window.partitionBy("request"))).filter("tier = _best")
    return best.drop("_best", "_short", "short", "qualified")


def path_suffix_join(left: DataFrame, right: DataFrame, left_path: str, right_path: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose paths are equal or one ends in ``/`` and the other: an equi-join on the file name (and the columns
    ``also``), then the test."""
    a, b = normal_path(F.col(left_path)), normal_path(F.col(right_path))
    left = left.withColumn("_base", F.substring_index(a, "/", -1))
    right = right.withColumn("_base", F.substring_index(b, "/", -1))
    test = (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))
    return left.join(right, ["_base", *also]).filter(test).drop("_base")


def path_suffix_equal(a: Column, b: Column) -> Column:
    a, b = normal_path(a), normal_path(b)
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


def in_scope(path: Column, prefix: str) -> Column:
    """The path itself, or below it as a directory; an empty prefix is everything. Both halves reach the parquet scan."""
    prefix = prefix.replace("\\", "/").strip("/")
    return (path == prefix) | path.startswith(prefix + "/") if prefix else F.lit(True)


def scoped(functions: DataFrame, prefix: str, path: str = "file_path") -> DataFrame:
    return functions.filter(in_scope(F.col(path), prefix)).orderBy(path, "start_line")


def call_sites(calls: DataFrame, files: DataFrame, functions: DataFrame, callee: str | None = None) -> DataFrame:
    """Call sites with their file and, where known, the calling function's name."""
    callers = functions.select(F.col("function_id").alias("caller_id"), F.col("name").alias("caller_name"))
    found = calls if callee is None else calls.filter(F.col("callee_name") == callee)
    return found.join(files, "file_id").join(callers, "caller_id", "left")


def first_body(functions: DataFrame, requests: DataFrame) -> DataFrame:
    """One body a requested name: the first by path and line."""
    rank = F.row_number().over(Window.partitionBy("name").orderBy("file_path", "start_line", "function_id"))
    return functions.join(requests.select("name").distinct(), "name", "left_semi").withColumn("_n", rank).filter("_n = 1").drop("_n")


def dyadic_nodes(start: str, end: str) -> Column:
    """The nodes ``(level, node)`` that cover the lines from ``start`` to ``end``: at most two a level, each of 2**level lines.

    At a level whole nodes lie between the first line rounded up and the line after the last rounded down; the one at either
    end that is no pair with its neighbour is taken, and the rest is left to the level above.
    """
    low = f"shiftright({start} + shiftleft(1L, k) - 1, k)"
    high = f"shiftright({end} + 1, k)"
    one = lambda node: f"struct(CAST(k AS INT) AS level, {node} AS node)"
    first = f"IF({low} < {high} AND {low} % 2 = 1, array({one(low)}), array())"
    last = f"IF({low} < {high} AND {high} % 2 = 1, array({one(f'{high} - 1')}), array())"
    return F.expr(f"flatten(transform(sequence(0, {LEVELS - 1}), k -> concat({first}, {last})))")


#: Lines are below 2**(LEVELS - 1).
LEVELS = 48


def containing_function(requests: DataFrame, functions: DataFrame, by_suffix: bool = False, total: int | None = None) -> DataFrame:
    """The innermost function that holds each ``requests(request_id, path, line)``: least extent, then path, then start.

    A function of any length lies in at most 2 log n dyadic nodes, and all lines of a node are held by it: so of each node
    only the innermost function counts. A request looks at the one node of each level above its line (of the levels that are
    in use), by joins with one fact a key whose hot keys are split, and takes the least of what it finds. No request meets
    more than one function a level, however many hold it. total: how many requests there are, if it is known.
    """
    ranges = functions.select("function_id", "name", "file_path", "start_line", "end_line").filter("start_line <= end_line AND end_line >= 0")
    ranges = ranges.withColumns({"_from": F.greatest("start_line", F.lit(0)).cast("long"), "_to": F.col("end_line").cast("long")})
    order = F.struct((F.col("end_line") - F.col("start_line")).alias("extent"), "file_path", "start_line", "function_id", "name", "end_line")
    own = F.col("file_path") if not by_suffix else normal_path(F.col("file_path"))
    cover = ranges.select(own.alias("_path"), order.alias("_best"), F.inline(dyadic_nodes("_from", "_to")))
    facts = cover.groupBy("_path", "level", "node").agg(F.min("_best").alias("_best"))
    # At most LEVELS numbers.
    levels = [r.level for r in cover.select("level").distinct().collect()]
    total = (requests.count() if total is None else total) * max(1, len(levels))
    asked = requests.withColumn("_path", F.col("path") if not by_suffix else normal_path(F.col("path")))
    above = F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(F.col("line").cast("long"), k).alias("node")) for k in sorted(levels))) if levels else F.array().cast("array<struct<level:int,node:long>>")
    asked = asked.filter("line >= 0").select("*", F.inline(above))
    if by_suffix:
        # Paths of one file name, cut to the last parts that the other has: a path meets each of its own tails.
        parts = F.split("_path", "/")
        tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/"))
        short = facts.withColumn("_tail", F.col("_path")).unionByName(facts.select("*", F.explode(tails).alias("_tail")).filter("_tail <> _path"))
        exact = asked.select("*", F.explode(tails).alias("_tail"))
        # The request's path ends in the function's, or the function's in the request's.
        down = join_fact(exact, facts.withColumnRenamed("_path", "_tail"), ["_tail", "level", "node"], total, "inner")
        up_facts = short.groupBy("_tail", "level", "node").agg(F.min("_best").alias("_best"))
        up = join_fact(asked.withColumn("_tail", F.col("_path")), up_facts, ["_tail", "level", "node"], total, "inner")
        found = down.unionByName(up)
    else:
        found = join_fact(asked, facts, ["_path", "level", "node"], total, "inner")
    best = found.groupBy(*requests.columns).agg(F.min("_best").alias("_best"))
    return best.select(*requests.columns, "_best.function_id", "_best.name", "_best.file_path", "_best.start_line", "_best.end_line")


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """``calls`` with callee_function_id: the one function of that name, else the one of that short name, else null.

    Where the full name is known but not unique, the short name is not tried.
    """
    full = functions.groupBy(F.col("name").alias("callee_name")).agg(F.count(F.lit(1)).alias("_n"), F.min("function_id").alias("_id"))
    short = functions.groupBy(short_name(F.col("name")).alias("_s")).agg(F.count(F.lit(1)).alias("_sn"), F.min("function_id").alias("_sid"))
    joined = calls.join(full, "callee_name", "left").join(short, short_name(F.col("callee_name")) == F.col("_s"), "left")
    target = F.when(F.col("_n").isNotNull(), F.when(F.col("_n") == 1, F.col("_id"))).when(F.col("_sn") == 1, F.col("_sid"))
    return joined.withColumn("callee_function_id", target).drop("_n", "_id", "_s", "_sn", "_sid")


def resolve_globals(references: DataFrame, variables: DataFrame) -> DataFrame:
    """``references(ref_id, name, file_id)`` with global_id: a static of the same file, else a non-static one, else any;
    the first of those. A reference that nothing answers keeps a null.

    Three tables with one variable a key, the first of each file's statics, of the non-static ones and of all, so that a
    reference meets at most three variables, however many share its name; hot names are split.
    """
    total = references.count()
    statics = variables.filter("is_static").groupBy("name", "file_id").agg(F.min("global_id").alias("_own"))
    by_name = variables.groupBy("name").agg(F.min(F.when(~F.col("is_static"), F.col("global_id"))).alias("_open"), F.min("global_id").alias("_any"))
    found = join_fact(join_fact(references, by_name, ["name"], total), statics, ["name", "file_id"], total)
    return found.withColumn("global_id", F.coalesce("_own", "_open", "_any")).select(*references.columns, "global_id")


def reachable_null_returners(functions: DataFrame, returns: DataFrame, known_null: list[str], known_nonnull: list[str], levels: int = 3) -> DataFrame:
    """Function names that can return NULL: rows ``(name, can_return_null)`` for all names defined or returned.

    returns(name, returned): name returns a NULL literal (returned is null) or the result of calling ``returned``. Known
    names are fixed; a name that is not defined can return NULL; a chain longer than ``levels`` cannot. Each level is one
    join, so no row is visited twice.
    """
    names = functions.select("name").distinct()
    mentioned = returns.filter(F.col("returned").isNotNull()).select(F.col("returned").alias("name")).unionByName(names).distinct()
    defined = names.withColumn("_defined", F.lit(True))
    base = mentioned.join(defined, "name", "left")
    fixed = F.when(F.col("name").isin(known_null), True).when(F.col("name").isin(known_nonnull), False)
    literal = returns.filter(F.col("returned").isNull()).select("name").distinct().withColumn("_literal", F.lit(True))
    base = base.join(literal, "name", "left").select("name", F.coalesce(fixed, F.when(F.col("_defined").isNull(), True), F.col("_literal"), F.lit(False)).alias("null0"), fixed.isNotNull().alias("_fixed"))
    state = base.select("name", F.col("null0").alias("can_return_null"), "_fixed")
    edges = returns.filter(F.col("returned").isNotNull()).select("name", "returned").distinct()
    for _ in range(levels - 1):
        above = edges.join(state.filter("can_return_null").select(F.col("name").alias("returned")), "returned", "left_semi").select("name").distinct().withColumn("_via", F.lit(True))
        state = state.join(above, "name", "left").select("name", F.when(F.col("_fixed"), F.col("can_return_null")).otherwise(F.col("can_return_null") | F.coalesce("_via", F.lit(False))).alias("can_return_null"), "_fixed")
    return state.drop("_fixed")
