"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree over permuted blocks."""

from collections.abc import Callable, Sequence
from fractions import Fraction
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch
from .rules import words

#: Buckets of one refinement step of the cut; the driver sees at most this many rows for each source.
FAN = 256


def targets(sizes: Sequence[int], weights: Sequence[int], total: Fraction, cap: int = 2) -> list[Fraction]:
    """Shares of total by weight, none above cap times its size; what is over goes to the others by weight."""
    out: dict[int, Fraction] = {}
    left, open_ = Fraction(total), {i for i, s in enumerate(sizes) if s}
    while open_:
        per = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if per * weights[i] > cap * sizes[i]]
        if not over:
            return [out.get(i, per * weights[i] if i in open_ else Fraction(0)) for i in range(len(sizes))]
        for i in over:
            out[i] = Fraction(cap * sizes[i])
            left -= out[i]
            open_.remove(i)
    return [out.get(i, Fraction(0)) for i in range(len(sizes))]


def split_tree(quotas: Sequence[int], n_shards: int, seed: int) -> Callable[[int, int], int]:
    """shard(source, rank): which output shard gets the rank-th block of a source's quota.

    A node holds a range of shards and a vector of block counts; its left half draws its part of the blocks without
    replacement, so each vector is multivariate hypergeometric and the quotas are kept exactly. Every node is seeded
    by its range: any task finds the same tree, walking only the paths that it needs.
    """
    known: dict[tuple[int, int], np.ndarray] = {}

    def left_of(lo: int, hi: int, have: np.ndarray) -> np.ndarray:
        if (lo, hi) not in known:
            rng, mid = np.random.default_rng([seed, lo, hi]), (lo + hi) // 2
            take = int(have.sum()) * (mid - lo) // (hi - lo)
            drawn, rest = np.zeros_like(have), int(have.sum())
            for i, n in enumerate(have):  # marginal by marginal
                rest -= int(n)
                drawn[i] = rng.hypergeometric(int(n), rest, take) if take and n else 0
                take -= int(drawn[i])
            known[lo, hi] = drawn
        return known[lo, hi]

    def shard(source: int, rank: int) -> int:
        lo, hi, have = 0, n_shards, np.asarray(quotas, dtype=np.int64)
        while hi - lo > 1:
            left = left_of(lo, hi, have)
            if rank < left[source]:
                hi, have = (lo + hi) // 2, left
            else:
                rank -= int(left[source])
                lo, have = (lo + hi) // 2, have - left
        return lo

    return shard


def _permutation(n: int, seed: int, source: int, turn: int) -> tuple[int, int]:
    """(a, c) of the bijection b -> (a * b + c) mod n."""
    rng = np.random.default_rng([seed, source, turn, 1])
    a = int(rng.integers(1, n + 1))
    while gcd(a, n) != 1:
        a += 1
    return a % max(n, 1), int(rng.integers(0, n))


def mix(
    docs: DataFrame, scratch: Scratch, text: str = "text", source: str = "source", key: str = "doc_id",
    weights: Sequence[int] = (5, 2, 1), share: Fraction = Fraction(3, 2), cap: int = 2,
    block_docs: int = 64, shard_words: int = 2_000_000, seed: int = 17,
) -> DataFrame:
    """(row columns of docs' key and source), m_size, m_source_size, m_target, m_copies and m_shards for every row.

    Sizes are words; sources in code-point order (null last) weigh as in weights, repeating. A source with target t and
    size s gives every document floor(t / s) times and fills the rest with permuted blocks, the last one document by
    document, without those that are too long for what is left. m_shards has an output shard for each copy. The driver holds one row a
    source and FAN rows a source for each refinement step; documents are never grouped by source. Null texts and empty
    ones have size 0 and no copy beyond those of whole turns; repeated rows are drawn alike; extra columns are ignored.
    Deterministic for a seed.
    """
    spark = docs.sparkSession
    h = F.xxhash64(F.lit(seed), F.col(key))
    base = scratch.write(docs.select(F.col(key).alias("k"), F.col(source).alias("s"), F.size(words(F.col(text))).cast("long").alias("size"), h.alias("h")))
    per = sorted(base.groupBy("s").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect(), key=lambda r: (r.s is None, (r.s or "").encode()))
    sizes, n = [int(r["size"]) for r in per], len(per)
    goal = targets(sizes, [weights[i % len(weights)] for i in range(n)], share * sum(sizes), cap)
    blocks = [max(1, -(-r["n"] // block_docs)) for r in per]
    turns = [int(g // s) if s else 0 for g, s in zip(goal, sizes, strict=True)]
    rest = [g - s * t for g, s, t in zip(goal, sizes, turns, strict=True)]
    schema = "s string, i int, blocks long, source_size long, target double, turns int, a long, c long"
    facts = spark.createDataFrame([(r.s, i, blocks[i], sizes[i], float(goal[i]), turns[i], *_permutation(blocks[i], seed, i, turns[i])) for i, r in enumerate(per)], schema)
    facts = F.broadcast(facts) if n <= 100_000 else facts
    block, rank = F.expr("pmod(h, blocks)"), F.expr("(pmod(h, blocks) * a + c) % blocks")
    facts = facts.withColumnRenamed("s", "fs")
    rows = base.join(facts, F.col("s").eqNullSafe(F.col("fs"))).drop("fs").withColumn("block", block).withColumn("rank", rank)

    # the rank of the block where the partial turn of each source ends, found by narrowing a range of ranks
    low, high, left = [0] * n, list(blocks), [int(x * 2) for x in rest]  # twice the words, to stay whole
    while any(h_ - l_ > 1 for l_, h_ in zip(low, high, strict=True)):
        at = spark.createDataFrame([(i, low[i], high[i], max(1, -(-(high[i] - low[i]) // FAN))) for i in range(n)], "j int, low long, high long, width long")
        at = F.broadcast(at) if n <= 100_000 else at
        sums = rows.join(at, rows.i == at.j).where("rank >= low and rank < high").groupBy("i", F.expr("(rank - low) div width").alias("b"), "width").agg(F.sum("size").alias("w"))
        found: dict[int, dict[int, int]] = {}
        width = {}
        for r in sums.collect():
            found.setdefault(r.i, {})[r.b] = int(r.w)
            width[r.i] = int(r.width)
        for i in range(n):
            step, lo, hi = width.get(i, 1), low[i], high[i]
            if i not in found:
                high[i] = lo + 1
                continue
            for b in range(-(-(hi - lo) // step)):
                w = 2 * found[i].get(b, 0)
                if w > left[i] or lo + (b + 1) * step >= hi:
                    low[i], high[i] = lo + b * step, min(hi, lo + (b + 1) * step)
                    break
                left[i] -= w
    quotas = [b * t + lo + 1 for b, t, lo in zip(blocks, turns, low, strict=True)]
    n_shards = max(1, -(-int(share * sum(sizes)) // shard_words))

    # documents of the block at the cut: in the order of another hash, up to the nearest sum
    cut = spark.createDataFrame([(i, low[i], left[i], [b for t in range(turns[i] + 1) for b in _permutation(blocks[i], seed, i, t)]) for i in range(n)], "j int, cut long, words2 long, perms array<long>")
    cut = F.broadcast(cut) if n <= 100_000 else cut
    rows = rows.join(cut, rows.i == cut.j).drop("j")
    edge = rows.where("rank = cut and size > 0").groupBy("i", "k").agg(F.sum("size").alias("w"), F.first("words2").alias("words2"))
    # one that is too long for what is left is passed over; about block_docs keys of each source come together here
    edge = edge.groupBy("i").agg(F.first("words2").alias("words2"), F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(seed + 1), "k").alias("o"), "k", "w"))).alias("keys"))
    fits = F.aggregate(
        "keys", F.struct(F.col("words2").alias("left"), F.filter("keys", lambda _: F.lit(False)).alias("got")),
        lambda a, e: F.when(e["w"] <= a["left"], F.struct((a["left"] - 2 * e["w"]).alias("left"), F.concat(a["got"], F.array(e)).alias("got"))).otherwise(a),
        lambda a: a["got"],
    )
    edge = edge.select(F.col("i").alias("ei"), F.explode(fits).alias("e")).select("ei", F.col("e.k").alias("ek"))
    edge = F.broadcast(edge) if n <= 1000 and block_docs <= 4096 else edge  # at most a block of each source
    rows = rows.join(edge, (rows.i == edge.ei) & rows.k.eqNullSafe(edge.ek), "left")
    rows = rows.withColumn("copies", F.col("turns") + F.when((F.col("rank") < F.col("cut")) | F.col("ei").isNotNull(), 1).otherwise(0))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def shards(i: pd.Series, block: pd.Series, blocks: pd.Series, copies: pd.Series, perms: pd.Series) -> pd.Series:
        find, known, out = split_tree(quotas, n_shards, seed), {}, []
        for s, b, n_, m, p in zip(i, block, blocks, copies, perms, strict=True):
            if (s, b, m) not in known:
                known[s, b, m] = [find(s, t * n_ + (int(p[2 * t]) * b + int(p[2 * t + 1])) % n_) for t in range(m)]
            out.append(known[s, b, m])
        return pd.Series(out)

    placed = rows.withColumn("shards", shards("i", "block", "blocks", "copies", "perms"))
    return placed.select(
        F.col("k").alias(key), F.col("s").alias(source), F.col("size").alias("m_size"), F.col("source_size").alias("m_source_size"),
        F.col("target").alias("m_target"), F.col("copies").alias("m_copies"), F.col("shards").alias("m_shards"),
    )


def mixed_documents(docs: DataFrame, scratch: Scratch, key: str = "doc_id", seed: int = 17, source: str = "source", **options) -> DataFrame:
    """The rows of docs, each as often as drawn: a partition per output shard, shuffled inside."""
    # rows of one key and source are drawn alike, those of one key in several sources are not
    plan = mix(docs, scratch, key=key, seed=seed, source=source, **options).select(F.col(key).alias("m_key"), F.col(source).alias("m_source"), "m_shards")
    plan = scratch.write(plan.where(F.size("m_shards") > 0).dropDuplicates(["m_key", "m_source"]))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("r_key"), F.col(source).alias("r_source"))
    out = rows.join(plan.hint("merge"), F.col("r_key").eqNullSafe(F.col("m_key")) & F.col("r_source").eqNullSafe(F.col("m_source")))
    out = out.select("row", "r_key", "m_shards", F.posexplode("m_shards").alias("m_at", "m_shard"))
    out = out.withColumn("m_turn", F.expr("size(filter(slice(m_shards, 1, m_at + 1), x -> x = m_shard))"))
    order = F.xxhash64(F.lit(seed + 2), "r_key", "m_turn", "m_shard")
    n_shards = 1 + (plan.agg(F.max(F.array_max("m_shards"))).first()[0] or 0)
    return out.withColumn("m_order", order).repartitionById(n_shards, F.col("m_shard").cast("int")).sortWithinPartitions("m_order").select("row.*")


def digest(docs: DataFrame, scratch: Scratch) -> DataFrame:
    m = mix(docs, scratch)
    return m.select("doc_id", F.col("m_size").alias("size"), F.col("m_source_size").alias("source_size"), F.col("m_target").alias("target"),
                    (F.col("m_size") * F.col("m_copies")).alias("taken"), F.col("m_shards").alias("shards"))
