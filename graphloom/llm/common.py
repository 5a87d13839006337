"""Scratch tables, connected components and small helpers shared by the operators."""

import atexit
import contextlib
import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as a Java regular expression: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints. Where none is set a temporary one serves a local master (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_roots: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _leave() -> None:
    """Results read scratch tables as long as the application runs; then they go."""
    for spark, root in _roots:
        with contextlib.suppress(Exception):  # the JVM may be gone
            _delete(spark, root)


class Scratch:
    """Tables written once to the shared folder, so that later steps survive lost executors and don't recompute."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        _roots.append((spark, self.root))
        rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if spark.conf.get(rows) == "10000":  # Spark's default makes batches of tens of megabytes from texts
            spark.conf.set(rows, "1000")
        self.n = 0

    def write(self, df: DataFrame, codec: str = "zstd", batch_rows: int | None = None) -> DataFrame:
        """batch_rows: at most so many rows at once between Spark and Python, for plans with large rows."""
        self.n += 1
        path, name = f"{self.root}/{self.n}", "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(name)
        try:
            if batch_rows:
                self.spark.conf.set(name, batch_rows)
            df.write.option("compression", codec).parquet(path)
        finally:
            self.spark.conf.set(name, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            _delete(self.spark, t._scratch_path)

    def free_shuffles(self) -> None:
        """Let the context cleaner delete shuffle files of plans that are no longer referenced."""
        for _ in range(2):  # the first round lets go of the plans, the second finds their shuffles unreferenced
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.3)


def input_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate of a DataFrame, in bytes (for files: their size)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of edges(a, b); component is the smallest id reachable.

    Alternating large-star and small-star rounds: each shuffles the edges only, combines before shuffling
    and needs O(log n) rounds; the edges of a round are a written table, so lineage stays short.
    """
    e = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    mark = None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u != v").distinct()
        )
        new = scratch.write(small)
        scratch.drop(e)
        e = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.groupBy("u").agg(F.min("v").alias("component"))
    return roots.select(F.col("u").alias("id"), "component").union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
