"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and \t \n \v \f \r, which is also what ``bytes.split()`` yields.
WORD = r"[^\x20\x09-\x0D]+"
MASK64 = (1 << 64) - 1


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode a temporary folder."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/llm-{context.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later reads do not depend on executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete materialized tables that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        jvm = spark.sparkContext._jvm
        for file in table.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def column_or_null(df: DataFrame, name: str, kind: str):
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns of ``df``."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class UnionFind:
    """Over 0..n-1, for the links found inside one bounded block."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, a: int) -> int:
        parent = self.parent
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def components_of_pairs(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least index of each index's component, by label propagation with pointer jumping."""
    label = np.arange(n)
    while len(left):
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


#: A key with so many rows is heavy; of a table of n rows at most n / max(HUB, n / MAX_HUBS) keys are, so at most MAX_HUBS.
HUB = 256
MAX_HUBS = 4096
#: So many rows are few.
FEW_ROWS = 100_000


#: Keys (of 16 bytes or so each) that a task may hold: some 30 MB.
FEW_KEYS = 1_000_000


def few(df: DataFrame, most: int = FEW_KEYS) -> DataFrame:
    """The written table ``df``, marked to be broadcast if it has at most ``most`` rows; a larger one is left to be shuffled."""
    return F.broadcast(df) if df.count() <= most else df


def join_split(rows: DataFrame, facts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, which has one row a key and in ``copies`` how many of the ``total`` rows hold it.

    Rows of heavy keys stay where they are and meet their few facts, at most MAX_HUBS, by a broadcast; the rest is shuffled.
    Of few rows there are no more facts than rows: all of them are broadcast, which saves the shuffles.
    """
    if total <= FEW_ROWS:
        return rows.join(F.broadcast(facts), keys)
    hub = max(HUB, total // MAX_HUBS)
    heavy = F.broadcast(facts.filter(F.col("copies") >= hub))
    light = rows.join(heavy.select(*keys), keys, "left_anti").join(facts.filter(F.col("copies") < hub), keys)
    return rows.join(heavy, keys).unionByName(light)


def with_least(edges: DataFrame, total: int) -> DataFrame:
    """``edges(u, v)`` with m, the least v of each u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("copies"))
    return join_split(edges, least, ["u"], total).select("u", "v", "m")


def all_stars(pairs: DataFrame) -> bool:
    """Whether each node of ``pairs(a, b)`` is either a centre, never a b, or the b of one pair."""
    roles = pairs.select(F.col("a").alias("node"), F.lit(0).alias("leaf")).unionAll(pairs.select("b", F.lit(1)))
    both = roles.groupBy("node").agg(F.sum("leaf").alias("n"), F.min("leaf").alias("least")).filter("n > 1 or (n = 1 and least = 0)")
    return is_empty(both)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Rows ``(node, component)``, component being the least node reachable, of every node in ``edges(a, b)``.

    Large-star and small-star rounds as joins and grouped minima; each round is a written table, so the lineage stays
    short. No group is gathered into one task: minima are combined before the shuffle, and hubs are joined by a broadcast
    of bounded size. Ends when all links are stars around the least node.
    """
    pairs = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = materialize(pairs, name)
    while not all_stars(pairs):
        n = pairs.count()
        # Large star: each node links its larger neighbours to the least of its neighbourhood.
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = with_least(both, 2 * n).filter("v > u").select(F.least("m", "u").alias("a"), F.col("v").alias("b")).distinct()
        # Small star: each node links its smaller neighbours, and itself, to the least of them.
        large = materialize(large, name)
        small = with_least(large.select(F.col("b").alias("u"), F.col("a").alias("v")), large.count())
        small = small.select(F.col("m").alias("x"), F.col("v").alias("y")).unionAll(small.select(F.col("m").alias("x"), F.col("u").alias("y")))
        after = materialize(small.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), name)
        forget(pairs, large)
        pairs = after
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(pairs.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
