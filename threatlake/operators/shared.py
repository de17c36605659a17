"""Scratch tables in the shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


class Scratch:
    """Tables written once to the folder that all executors share (spark.checkpoint.dir).

    They cut the lineage: a lost executor costs only the running stage. Where the setting is
    missing a private folder serves a local master, as in tests; on a cluster it is an error.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            context = spark.sparkContext
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = _own.get(context.applicationId) or _own.setdefault(context.applicationId, tempfile.mkdtemp(prefix="threatlake-"))
        self.base = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Frees a table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the least node of the neighbourhood."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its lower neighbours move to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each component, for every node of an edge but the roots.

    edges: a, b of one orderable type; self-loops and repeats may occur. Large-star and
    small-star steps alternate. Each round is written to the scratch folder and replaces the
    one before. Raises if it has not settled after most_rounds (the number of rounds grows
    with the logarithm of the longest path).
    """
    now = scratch.keep(edges.select("a", "b").where("a <> b").distinct(), f"{name}-0")
    mark = None
    for k in range(1, most_rounds + 1):
        then = scratch.keep(_small(_large(now)), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        now = then
        was, mark = mark, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())
        if mark == was or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
