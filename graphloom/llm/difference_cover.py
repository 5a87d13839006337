"""Suffix sorting by Spark: the difference cover {1, 2} modulo 3 over range-partitioned sorts.

A row is a place of the text. Each level sorts the triples of the sampled places (those not divisible by 3), recurses on
their names, and merges the remaining suffixes by counting the sampled ones below them. Every sort is by range with the
place as its last key, so that a frequent triple is dealt to many tasks; only two rows a partition go to the driver.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .worker import tidy

#: Rows of a task; places of a window block.
TASK_ROWS, WINDOW = 1 << 19, 1 << 16
#: A reduced text of so many names or fewer is sorted in one task: three names then fit into 63 bits.
ONE_TASK = (1 << 21) - 16


def _names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(order, name of each key from 1, number of names)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    named = np.concatenate(([1], 1 + np.cumsum(ordered[1:] != ordered[:-1]))) if len(keys) else np.empty(0, np.int64)
    names = np.empty(len(keys), np.int64)
    names[order] = named
    return order, names, int(named[-1]) if len(keys) else 0


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of s (whole numbers from 1 below 2^21) in order; len(s) < 2^21 - 8."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    t = np.zeros(n + 4, dtype=np.int64)
    t[:n] = s
    one = np.arange(1, n + (n % 3 == 1), 3)  # with a dummy where the rest of length 1 needs it
    two = np.arange(2, n, 3)
    cover = np.concatenate((one, two))
    order, names, many = _names((t[cover] << 42) | (t[cover + 1] << 21) | t[cover + 2])
    if many < len(cover):
        order = suffix_array(names)
        names = np.empty(len(cover), np.int64)
        names[order] = np.arange(1, len(cover) + 1)
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[cover] = names
    first, second = order[order < len(one)], order[order >= len(one)]
    one, two = cover[first], cover[second]
    one = one[one < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort((t[rest] << 21) | rank[rest + 1], kind="stable")]
    # the place of each remaining suffix among the sampled ones, class by class
    below = np.searchsorted((t[one] << 21) | rank[one + 1], (t[rest] << 21) | rank[rest + 1])
    triple = lambda i: (t[i] << 42) | (t[i + 1] << 21) | rank[i + 2]
    below = below + np.searchsorted(triple(two), triple(rest))
    sampled = np.concatenate((one, two))
    sampled = sampled[np.argsort(rank[sampled], kind="stable")]
    out = np.empty(n, dtype=np.int64)
    at = below + np.arange(len(rest))
    out[at] = rest
    free = np.ones(n, dtype=bool)
    free[at] = False
    out[free] = sampled
    return out


def with_neighbours(df: DataFrame, at: str, columns: dict[str, tuple[int, ...]]) -> DataFrame:
    """df, whose `at` is dense from 0, with columns such as `f+1` and `f-1`: those of the rows so far ahead (null outside).

    Blocks of places are windows; the rows at their edges go to both blocks.
    """
    offsets = [k for ks in columns.values() for k in ks]
    ahead, behind = max(0, *offsets), max(0, *(-k for k in offsets))
    block = F.floor(F.col(at) / WINDOW)
    held = df.withColumn("block", F.explode(F.array_distinct(F.array(F.floor((F.col(at) - ahead) / WINDOW), block, F.floor((F.col(at) + behind) / WINDOW)))))
    w = Window.partitionBy("block").orderBy(at)
    near = held.select("*", *[F.lead(c, k).over(w).alias(f"{c}{k:+d}") for c, ks in columns.items() for k in ks])
    return near.where(F.col("block") == block).drop("block")


def _ranked(df: DataFrame, keys: list[str], rows: int, scratch: Scratch, flag: str | None = None) -> tuple[DataFrame, int, DataFrame]:
    """(df's column pos with place, row and ahead; number of different keys; the written table behind the first).

    place: rows with a smaller key; row: a number of its own in the order of keys; ahead: flagged rows with a smaller
    key, for rows without the flag.
    """
    last = [flag, "pos"] if flag else ["pos"]
    names = [*keys, *last]

    def run(batches):
        part, count, runs, flagged, prior, start = TaskContext.get().partitionId(), 0, 0, 0, None, 0

        def out(*cols, edge):
            n = len(cols[0])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), *(pa.array(np.asarray(c, np.int64)) for c in cols), pa.array([edge, *[None] * (n - 1)], pa.list_(pa.int64()))],
                names=["part", "pos", "start", "nth", "ahead", "runs", "edge"],
            )

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            k = np.stack([batch.column(c).to_numpy() for c in keys], axis=1)
            new = np.ones(n, bool)
            new[1:] = (k[1:] != k[:-1]).any(axis=1)
            new[0] = prior is None or bool((k[0] != prior).any())
            nth = np.arange(count, count + n)
            begin = np.maximum(np.maximum.accumulate(np.where(new, nth, -1)), start)
            f = batch.column(flag).to_numpy() if flag else np.zeros(n, np.int64)
            ahead, number = flagged + np.cumsum(f) - f, runs + np.cumsum(new)
            yield out(batch.column("pos").to_numpy(), begin, nth, ahead, number, edge=None if count else k[0].tolist())
            prior, start, count, flagged, runs = k[-1], int(begin[-1]), count + n, flagged + int(f.sum()), int(number[-1])
        if count:  # what the partition holds in all
            yield out([-1], [start], [count], [flagged], [runs], edge=prior.tolist())

    parts = 1 + rows // TASK_ROWS
    ordered = df.select(*names).repartitionByRange(parts, *names).sortWithinPartitions(*names)
    table = scratch.write(ordered.mapInArrow(tidy(run), "part int, pos long, start long, nth long, ahead long, runs long, edge array<long>"))
    firsts, ends = {}, {}
    for r in table.where("edge is not null").collect():  # two rows a partition
        if r.pos < 0:
            ends[r.part] = r
        elif r.nth == 0:
            firsts[r.part] = r.edge
    offsets, rows_before, flags_before, different, run_start, prior = [], 0, 0, 0, 0, None
    for part in sorted(ends):
        end, goes_on = ends[part], prior == firsts[part]
        offsets.append((part, rows_before, flags_before, run_start if goes_on else rows_before))
        different += end.runs - goes_on
        run_start = run_start if goes_on and end.runs == 1 else rows_before + end.start
        rows_before, flags_before, prior = rows_before + end.nth, flags_before + end.ahead, end.edge
    spark = scratch.spark
    few = F.broadcast(spark.createDataFrame(offsets or [(-1, 0, 0, 0)], "of int, before long, flags long, first long"))  # a row a partition
    got = table.where("pos >= 0").join(few, F.col("part") == F.col("of"))
    place = F.when(F.col("runs") == 1, F.col("first")).otherwise(F.col("before") + F.col("start"))
    got = got.select("pos", place.alias("place"), (F.col("before") + F.col("nth")).alias("row"), (F.col("flags") + F.col("ahead")).alias("ahead"))
    scratch.free_shuffles()
    return got, different, table


def _in_one_task(text: DataFrame) -> DataFrame:
    """(pos, place) of a text of at most ONE_TASK names: the recursion's end."""

    def run(batches):
        pos, sym = [], []
        for batch in batches:
            pos.append(batch.column(0).to_numpy())
            sym.append(batch.column(1).to_numpy())
        if pos:
            at = np.concatenate(pos)
            s = np.empty(len(at), np.int64)
            s[at] = 1 + np.unique(np.concatenate(sym), return_inverse=True)[1]
            order = suffix_array(s)
            for k in range(0, len(order), 1 << 16):
                cut = order[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(cut), pa.array(np.arange(k, k + len(cut)))], names=["pos", "place"])

    return text.select("pos", "sym").repartition(1).mapInArrow(tidy(run), "pos long, place long")


def _places(text: DataFrame, n: int, covered: int, depth: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((pos, place, row) of the suffixes of text, its written table); pos dense from 0, sym > 0; right to `depth` symbols.

    covered: how many symbols of the first text a symbol stands for. Tables go as soon as nothing reads them.
    """
    triples = with_neighbours(text.select("pos", "sym"), "pos", {"sym": (1, 2)})
    triples = scratch.write(triples.select("pos", F.col("sym").alias("a"), F.coalesce("sym+1", F.lit(0)).alias("b"), F.coalesce("sym+2", F.lit(0)).alias("c")))
    scratch.free_shuffles()
    cover = triples.where("pos % 3 != 0")
    ones, sampled = (n + 1) // 3, (n + 1) // 3 + n // 3
    if n % 3 == 1:  # an empty triple ends the sampled places of remainder 1
        cover = cover.union(scratch.spark.range(1).select(F.lit(n).cast("long").alias("pos"), *[F.lit(0).cast("long").alias(c) for c in "abc"]))
        ones, sampled = ones + 1, sampled + 1
    names, different, held = _ranked(cover, ["a", "b", "c"], sampled, scratch)
    if different < sampled and 3 * covered < depth:
        number = F.floor(F.col("pos") / 3) + F.when(F.col("pos") % 3 == 2, ones).otherwise(0)
        shorter = scratch.write(names.select(number.alias("pos"), (F.col("place") + 1).alias("sym")))
        scratch.drop(held)
        if sampled <= ONE_TASK:
            got = held = scratch.write(_in_one_task(shorter))
        else:
            got, held = _places(shorter, sampled, 3 * covered, depth, scratch)
        scratch.drop(shorter)
        back = F.when(F.col("pos") < ones, 3 * F.col("pos") + 1).otherwise(3 * (F.col("pos") - ones) + 2)
        names = got.select(back.alias("pos"), "place")
    ranks = names.select(F.col("pos").alias("at"), (F.col("place") + 1).alias("r"))
    known = triples.join(ranks, F.col("pos") == F.col("at"), "left").select("pos", "a", "b", "r")
    known = with_neighbours(known, "pos", {"r": (1, 2)})
    # behind the end there is only the empty suffix; the sampled place n, where it was added, has the least rank as well
    known = scratch.write(known.select("pos", "a", "b", "r", F.coalesce("r+1", F.lit(0)).alias("r1"), F.coalesce("r+2", F.lit(0)).alias("r2"), (F.col("pos") % 3).alias("m")))
    scratch.drop(triples, held)
    scratch.free_shuffles()
    first, _, one = _ranked(known.where("m != 2").select("pos", "a", "r1", (F.col("m") == 1).cast("long").alias("one")), ["a", "r1"], 2 * n // 3, scratch, "one")
    second, _, two = _ranked(known.where("m != 1").select("pos", "a", "b", "r2", (F.col("m") == 2).cast("long").alias("two")), ["a", "b", "r2"], 2 * n // 3, scratch, "two")
    rest = first.where("pos % 3 = 0").select("pos", F.col("ahead").alias("x"), F.col("place").alias("idx")).join(second.where("pos % 3 = 0").select(F.col("pos").alias("at"), F.col("ahead").alias("y")), F.col("pos") == F.col("at"))
    rest = rest.select("pos", (F.col("x") + F.col("y")).alias("below"), F.lit(0).cast("long").alias("kind"), "idx")
    skip = 1 if n % 3 == 1 else 0  # the empty triple is the least of the sampled ones and no suffix
    mine = known.where("m != 0").select("pos", (F.col("r") - 1 - skip).alias("below"), F.lit(1).cast("long").alias("kind"), F.lit(0).cast("long").alias("idx"))
    merged, _, table = _ranked(rest.union(mine), ["below", "kind", "idx"], n, scratch)
    scratch.drop(known, one, two)
    scratch.free_shuffles()
    return merged.select("pos", "place", "row"), table


def suffix_order(text: DataFrame, n: int, depth: int, scratch: Scratch) -> DataFrame:
    """(pos, row): the suffixes of text (pos dense from 0 to n - 1, sym > 0) in order; row is dense from 0.

    Suffixes that agree in `depth` symbols stand together, in any order; a depth of n sorts them wholly.
    """
    return _places(text, n, 1, depth, scratch)[0].select("pos", "row")
