"""Embedding near-duplicates by product quantisation: inverted lists, residual codes, table lookups, exact cosine."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components
from .worker import tidy


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmin((centres**2).sum(1) - 2 * x[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        held, begin = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(x[order], begin, axis=0)
        centres[held] = sums / np.bincount(near, minlength=len(centres))[held][:, None]
    return centres


class Quantiser:
    """Coarse centres of unit vectors and a codebook for each subspace of what remains."""

    def __init__(self, sample: np.ndarray, n_lists: int, n_parts: int, n_codes: int, seed: int):
        rng = np.random.default_rng(seed)
        self.dim, self.parts = sample.shape[1], n_parts
        self.sub = -(-self.dim // n_parts)
        self.centres = _kmeans(sample, n_lists, rng)
        rest = self._split(sample - self.centres[self.lists(sample)[0]])
        self.books = [_kmeans(np.ascontiguousarray(rest[:, p]), n_codes, rng) for p in range(n_parts)]

    def _split(self, x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), self.parts * self.sub))
        wide[:, : self.dim] = x
        return wide.reshape(len(x), self.parts, self.sub)

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest list, squared distances to all centres)."""
        d = (x**2).sum(1)[:, None] + (self.centres**2).sum(1) - 2 * x @ self.centres.T
        return np.argmin(d, axis=1), d

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, distance of each vector from what its codes stand for)."""
        rest = self._split(x - self.centres[lists])
        codes, back = np.empty((len(x), self.parts), np.uint8), np.empty_like(rest)
        for p, book in enumerate(self.books):
            codes[:, p] = np.argmin((book**2).sum(1) - 2 * rest[:, p] @ book.T, axis=1)
            back[:, p] = book[codes[:, p]]
        return codes, np.sqrt(((rest - back) ** 2).sum((1, 2)))

    def distances(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of queries to the coded members of a list, by table lookups."""
        rest = self._split(queries - self.centres[which])
        out = np.zeros((len(queries), len(codes)))
        for p, book in enumerate(self.books):
            table = (rest[:, p] ** 2).sum(1)[:, None] + (book**2).sum(1) - 2 * rest[:, p] @ book.T
            out += table[:, codes[:, p]]
        return out


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Indexes of the pairs that join parts not joined yet (a spanning forest)."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append(i)
    return out


def _unit(raw: list, dim: int) -> np.ndarray:
    x = np.zeros((len(raw), dim))
    for i, r in enumerate(raw):
        v = np.frombuffer(r, "<f8")
        x[i, : len(v)] = v
    return x


def near_vectors(
    vectors: DataFrame, scratch: Scratch, key: str = "vec_id", embedding: str = "embedding", cosine: float = 0.95,
    sample: int = 50_000, most_lists: int = 4096, parts: int = 8, codes: int = 256, margin: float = 0.15, block: int = 2048, seed: int = 3,
) -> DataFrame:
    """(key, n_links, component_id, kept) of every row: links are pairs with a cosine of at least `cosine` in doubles.

    Equal vectors are one class from the start. The quantiser is fitted on at most `sample` vectors (the least hashes of
    their keys); all are indexed. There are about sqrt(rows) lists, at most most_lists; a vector looks into every list
    whose squared distance exceeds that of its own by at most `margin`: near vectors leave a list's neighbourhood only
    beyond it, and the number of probes isn't capped. Each pair of lists is visited from the lower one. Codes only rule
    pairs out where distance and coding error prove them too far, so nothing found near is lost before the exact
    cosine. Large lists are cut into blocks of `block` members; a block returns counts and a spanning forest of its
    links, never its pairs.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; shorter ones are taken
    as padded with zeros. Null keys link with nothing (component null, kept). Rows that repeat a key and a vector
    count as other vectors. Extra columns are ignored; an empty table gives no row.
    """
    spark = vectors.sparkSession
    e = F.transform(F.col(embedding), lambda x: x.cast("double"))
    fine = F.size(e) > 0
    fine &= ~F.coalesce(F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    fine &= F.exists(e, lambda x: x != 0)

    def packed(batches):  # doubles of the unit vector
        for b in batches:
            out = []
            for x in b.column(1).to_pylist():
                v = np.asarray(x, dtype=np.float64)
                v = v / np.abs(v).max()
                out.append((v / np.sqrt((v * v).sum())).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "v"])

    rows = vectors.select(F.col(key).cast("long").alias("id"), F.when(F.coalesce(fine, F.lit(False)), e).alias("e"))
    every = scratch.write(rows.where("id is not null and e is not null").mapInArrow(tidy(packed), "id long, v binary"))
    classes = scratch.write(every.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "n", "v"))
    total, width = classes.agg(F.count("*"), F.max(F.length("v"))).first()
    if not total:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    dim = width // 8
    fit = _unit([r.v for r in classes.orderBy(F.xxhash64(F.lit(seed), "id")).limit(sample).collect()], dim)
    index = spark.sparkContext.broadcast(Quantiser(fit, min(most_lists, max(1, round(total**0.5))), min(parts, dim), min(codes, len(fit)), seed))

    def assigned(batches):
        for b in batches:
            x = _unit(b.column(2).to_pylist(), dim)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(index.value.lists(x)[0], pa.int32())], names=["id", "n", "v", "list"])

    placed = scratch.write(classes.mapInArrow(tidy(assigned), "id long, n long, v binary, list int"))
    blocks = {r.list: -(-r.c // block) for r in placed.groupBy("list").agg(F.count("*").alias("c")).collect()}  # a row a list
    blocks = spark.sparkContext.broadcast(blocks)

    def dealt(batches):
        """Each vector as a member of its list's block (role 0) and as a query of every block that it probes (role 1)."""
        q = index.value
        for b in batches:
            ids, n, v, own = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2), b.column(3).to_numpy()
            for at in range(0, len(ids), 512):
                s = slice(at, at + 512)
                x = _unit(v[s].to_pylist(), dim)
                d = q.lists(x)[1]
                near = d <= d[np.arange(len(x)), own[s]][:, None] + margin
                near &= np.arange(d.shape[1]) >= own[s][:, None]
                which, to, part, role = [], [], [], []
                for i, l in zip(*np.nonzero(near), strict=True):
                    count = blocks.value.get(int(l), 0)
                    which += [at + i] * count
                    to += [l] * count
                    part += range(count)
                    role += [1] * count
                for i, l in enumerate(own[s]):
                    which.append(at + i)
                    to.append(l)
                    part.append(int(ids[at + i]) * 0x9E3779B1 % 4294967291 % blocks.value[int(l)])
                    role.append(0)
                which = np.asarray(which)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.int32()), pa.array(part, pa.int32()), pa.array(role, pa.int32()), pa.array(ids[which]), pa.array(n[which]), pa.array(own[which]), v.take(pa.array(which))],
                    names=["list", "part", "role", "id", "n", "own", "v"],
                )

    near2 = 2 - 2 * cosine

    def matched(batches):
        q = index.value
        here, members, waiting = None, [], []

        def solve():
            mid, mn, mx, mcodes, mreach = here_block()
            qid, qn = np.array([r[3] for r in waiting]), np.array([r[4] for r in waiting])
            own, qx = np.array([r[5] for r in waiting]), _unit([r[6] for r in waiting], dim)
            maybe = q.distances(qx, here[0], mcodes) <= mreach
            i, j = np.nonzero(maybe & ((own != here[0])[:, None] | (qid[:, None] < mid[None, :])))
            keep = np.concatenate([np.einsum("ij,ij->i", qx[i[k : k + 4096]], mx[j[k : k + 4096]]) >= cosine for k in range(0, len(i), 4096)]) if len(i) else np.empty(0, bool)
            i, j = i[keep], j[keep]
            waiting.clear()
            if not len(i):
                return
            edge = _forest(qid[i], mid[j])
            count_q, count_m = np.bincount(i, weights=mn[j], minlength=len(qid)), np.bincount(j, weights=qn[i], minlength=len(mid))
            ids = np.concatenate((qid[count_q > 0], mid[count_m > 0]))
            counts = np.concatenate((count_q[count_q > 0], count_m[count_m > 0])).astype(np.int64)
            a, b = np.concatenate((qid[i][edge], ids)), np.concatenate((mid[j][edge], counts))
            yield pa.RecordBatch.from_arrays([pa.array([True] * len(edge) + [False] * len(ids)), pa.array(a), pa.array(b)], names=["edge", "a", "b"])

        known = {}

        def here_block():
            if known.get("at") != here:
                x = _unit([r[6] for r in members], dim)
                c, error = q.encode(x, np.full(len(members), here[0]))
                known.update(at=here, block=(np.array([r[3] for r in members]), np.array([r[4] for r in members]), x, c, (near2**0.5 + error) ** 2 + 1e-9))
            return known["block"]

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[:2] != here:
                    if waiting:
                        yield from solve()
                    here, members = r[:2], []
                if r[2] == 0:
                    members.append(r)
                elif members:
                    waiting.append(r)
                    if len(waiting) == 512:
                        yield from solve()
        if waiting:
            yield from solve()

    work = placed.mapInArrow(tidy(dealt), "list int, part int, role int, id long, n long, own int, v binary").repartition("list", "part").sortWithinPartitions("list", "part", "role")
    found = scratch.write(work.mapInArrow(tidy(matched), "edge boolean, a long, b long"))
    counts = found.where("not edge").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("c"))
    components = connected_components(found.where("edge").select("a", "b"), scratch)
    per = classes.select("v", "n", F.col("id").alias("rep")).join(counts, "rep", "left").join(components.withColumnRenamed("id", "rep"), "rep", "left")
    per = per.select("v", (F.coalesce("c", F.lit(0)) + F.col("n") - 1).alias("l"), F.coalesce("component", "rep").alias("component"))
    linked = scratch.write(every.join(per, "v").select("id", "l", "component"))
    rest = rows.where("id is null or e is null").select("id", F.lit(0).cast("long").alias("l"), F.col("id").alias("component"))
    out = linked.union(rest)
    return out.select(F.col("id").alias(key), F.col("l").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
