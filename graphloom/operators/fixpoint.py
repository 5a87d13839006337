"""Semi-naive fixpoints over written tables: transitive closures, components, rule sets."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROUNDS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints. Where none is set a temporary one serves a local master (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there and lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fixpoint(seed: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], max_rounds: int | None = MAX_ROUNDS) -> DataFrame:
    """The least set that holds seed and step(new rows, all rows); rounds join only the new rows. None: no limit of rounds."""
    total = delta = written(seed.distinct())
    parts = [total]
    for _ in count() if max_rounds is None else range(max_rounds):
        found = step(delta, total).distinct().join(total, total.columns, "left_anti").select(*total.columns)
        delta = written(found)
        if delta.isEmpty():
            discard(delta)
            return total
        parts.append(delta)
        total = total.union(delta)
        if len(parts) == 12:
            total = written(total)
            discard(*(p for p in parts if p is not delta))
            parts = [total]
    raise RuntimeError(f"no fixpoint in {max_rounds} rounds")


def closure(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(s, o, ...) pairs over one or more steps. With seeds (s) it walks from them, else the reach doubles each round."""
    keys = [c for c in edges.columns if c not in ("s", "o")]
    edges = written(edges.distinct())

    def compose(first: DataFrame, then: DataFrame) -> DataFrame:
        then = then.toDF(*[f"then_{c}" for c in then.columns])
        meets = F.col("o") == F.col("then_s")
        for k in keys:
            meets = meets & (F.col(k) == F.col(f"then_{k}"))
        return first.join(then, meets).withColumn("o", F.col("then_o")).select(*edges.columns)

    if seeds is not None:
        return fixpoint(edges.join(seeds.distinct(), ["s"], "left_semi").select(*edges.columns), lambda new, _: compose(new, edges), None)  # ends on finite edges
    return fixpoint(edges, lambda new, total: compose(new, total).union(compose(total, new)))


def components(edges: DataFrame) -> DataFrame:
    """(n, component) over undirected edges (a, b); component is the least name reachable. Hooking and doubling."""
    e = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    e = written(e)
    label = written(e.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("n"), F.least("a", "low").alias("component")))
    for _ in range(MAX_ROUNDS):
        near = e.join(label.withColumnsRenamed({"n": "b", "component": "c"}), "b").groupBy(F.col("a").alias("n")).agg(F.min("c").alias("c"))
        hooked = label.join(near, "n").select("n", F.least("component", "c").alias("component"))
        jump = hooked.select(F.col("n").alias("component"), F.col("component").alias("up"))
        new = written(hooked.join(jump, "component", "left").select("n", F.least("component", F.coalesce("up", "component")).alias("component")))
        settled = new.join(label, ["n", "component"], "left_anti").isEmpty()
        discard(label)
        if settled:
            discard(e)
            return new
        label = new
    raise RuntimeError("components did not settle")
