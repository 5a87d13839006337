"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components
from .worker import slices, tidy

_U = np.uint64
_NONE = _U(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), elementwise."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Sets of hashed word shingles; words are hashed once while they stay in a bounded cache."""

    def __init__(self, width: int, bound: int = 150_000):
        self.width, self.bound, self.known = width, bound, {}

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.bound:
            known.clear()
        try:
            return np.fromiter([known[w] for w in words], dtype=_U, count=len(words))
        except KeyError:
            out = []
            for w in words:
                h = known.get(w)
                if h is None:
                    h = xxhash.xxh3_64_intdigest(w)
                    if len(w) <= 64 and len(known) <= 2 * self.bound:
                        known[w] = h
                out.append(h)
            return np.fromiter(out, dtype=_U, count=len(out))

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text (A-Z lowered, words between ASCII white space)."""
        lists = [(t or "").encode().lower().split() for t in texts]
        flat = self.word_hashes([w for ws in lists for w in ws])
        out, at = [], 0
        for ws in lists:
            h, n = flat[at : at + len(ws)], len(ws)
            at += n
            if not n:
                out.append(h)
                continue
            m = max(1, n - self.width + 1)
            acc = np.full(m, min(n, self.width), dtype=_U)
            for j in range(min(n, self.width)):
                acc = _mixed((acc ^ h[j : j + m]) * _U(0x9E3779B97F4A7C15) + _U(j + 1))
            acc.sort()
            out.append(acc[np.concatenate(([True], acc[1:] != acc[:-1]))])
        return out


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches: len(sets) x t. In round i < t each element throws a hash into a random coordinate, in
    round t + j into coordinate j; rounds rank before hashes. A set stops at the round that fills its last coordinate,
    so every coordinate is filled; equal coordinates of two sets estimate their Jaccard similarity."""
    out = np.full(len(sets) * t, _NONE, dtype=_U)
    flat = np.concatenate(sets) if sets else np.empty(0, _U)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for i in range(2 * t):
        if not len(flat):
            break
        x = _mixed(flat ^ _mixed(np.full(1, i + 1, _U) * _U(0x9E3779B97F4A7C15)))
        place = ((x >> _U(32)) * _U(t) >> _U(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, row * t + place, (_U(i) << _U(32)) | (x & _U(0xFFFFFFFF)))
        short = (out.reshape(-1, t) == _NONE).any(axis=1)
        go = short[row]
        if not go.all():
            flat, row = flat[go], row[go]
    return out.reshape(-1, t)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A hash for each band of `rows` coordinates."""
    parts = sketch.reshape(len(sketch), -1, rows)
    acc = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=_U), parts.shape[:2])
    for j in range(rows):
        acc = _mixed((acc ^ parts[:, :, j]) * _U(0x9E3779B97F4A7C15) + _U(j))
    return acc.view(np.int64)


def _signatures(docs: DataFrame, text: str, key: str, width: int, bands: int, rows: int) -> DataFrame:
    def run(batches):
        shingler = Shingler(width)
        for batch in slices(batches, rows=256, size=2_000_000):
            sets = shingler.sets(batch.column(1).to_pylist())
            keys = band_keys(sketches(sets, bands * rows), rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([k.tobytes() if len(s) else None for k, s in zip(keys, sets, strict=True)], pa.binary()),
                ],
                names=["id", "n", "sig", "keys"],
            )

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(tidy(run), "id long, n long, sig binary, keys binary")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        shingler = Shingler(width)
        for batch in slices(batches, rows=256, size=2_000_000):
            sets = shingler.sets(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])

    return docs.mapInArrow(tidy(run), "id long, shingles binary")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = np.concatenate((x, y))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


def _block_links(rows: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) inside large buckets, as a spanning forest of each pair of blocks; rows: key, m, id, c.

    Members of a bucket's largest component need to meet only those outside it, and these meet each other. Both parts
    are cut into blocks of about `block` members and two blocks meet in a task of their own, where the sizes of all
    intersections come from one matrix product over the shingles on both sides. So a large group with a few strangers
    is dealt out once, not to every block. No pair leaves the task but those that join two components.
    """
    main = rows.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy(F.col("key").alias("of")).agg(F.max(F.struct("n", "c")).alias("top"))
    rows = rows.join(main, F.col("key") == F.col("of")).select("key", (F.col("m") - F.col("top.n")).alias("rest"), F.col("top.n").alias("main"), (F.col("c") == F.col("top.c")).alias("in_main"), "id", "c")

    def deal(batches):
        for batch in batches:
            out: list[tuple] = []
            for key, rest, main, in_main, i, c, x in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                few, many, place = -(-rest // block), -(-main // block), i * 0x9E3779B1 % 4294967291
                if in_main:  # its blocks have numbers below 0
                    own = -1 - place % many
                    out += [(key, own, j, own, i, c, x) for j in range(few)]
                else:
                    own = place % few
                    out += [(key, -1 - j, own, own, i, c, x) for j in range(many)]
                    out += [(key, min(own, j), max(own, j), own, i, c, x) for j in range(few)]
                if len(out) >= 512:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    def _rows(out):
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(col, type=t) for col, t in zip(zip(*out, strict=True), types, strict=True)], names=["key", "p", "q", "own", "id", "c", "x"])

    def solve(group):
        sides = [[r for r in group if r[3] == b] for b in sorted({r[3] for r in group})]
        left, right = (sides[0], sides[-1])
        if group[0][1] != group[0][2] and len(sides) < 2:
            return []
        if len({r[5] for r in group}) < 2:
            return []
        xs, ys = [np.frombuffer(r[6], _U) for r in left], [np.frombuffer(r[6], _U) for r in right]
        shared = np.intersect1d(np.concatenate(xs), np.concatenate(ys))
        same = np.zeros((len(xs), len(ys)), np.float32)
        for at in range(0, len(shared), 8192):
            part = shared[at : at + 8192]
            a, b = (_incidence(z, part) for z in (xs, ys))
            same += a @ b.T
        na, nb = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
        near = 100 * same >= percent * (na[:, None] + nb[None, :] - same)
        near &= np.array([r[5] for r in left])[:, None] != np.array([r[5] for r in right])[None, :]
        root = {}

        def find(v):
            while root.setdefault(v, v) != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        out = []
        for i, j in zip(*np.nonzero(near), strict=True):
            a, b = find(left[i][5]), find(right[j][5])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((left[i][4], right[j][4]))
        return out

    def run(batches):
        group: list[tuple] = []
        for batch in batches:
            for r in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if group and r[:3] != group[0][:3]:
                    if found := solve(group):
                        yield _pairs(found)
                    group = []
                group.append(r)
        if group and (found := solve(group)):
            yield _pairs(found)

    def _pairs(found):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    held = rows.join(sets.withColumnRenamed("id", "sid"), F.col("id") == F.col("sid")).select("key", "rest", "main", "in_main", "id", "c", "shingles")
    dealt = held.mapInArrow(tidy(deal), "key long, p int, q int, own int, id long, c long, x binary")
    return dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "id").mapInArrow(tidy(run), "a long, b long")


def _incidence(sets: list[np.ndarray], shingles: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(shingles)), np.float32)
    for i, s in enumerate(sets):
        at = np.searchsorted(shingles, s)
        at[at == len(shingles)] = 0
        out[i, at[shingles[at] == s]] = 1
    return out


def near_duplicates(
    docs: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80,
    bands: int = 40, rows: int = 5, small: int = 32, block: int = 192,
) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of docs.

    Documents whose shingle sets have 100 * intersection >= percent * union are linked. Equal sets are one class from
    the start. Classes that share a band key are candidates: first each with its bucket's least member (linear), then,
    only in buckets that still span several components, members of different components: as pairs in buckets of at
    most `small` members, in blocks that meet inside a task in larger ones. A pair inside one component is never
    needed, so groups of copies don't turn into all pairs, and no bucket is capped. At similarity 0.8 the defaults miss
    a pair with probability 1.3e-7. All links are confirmed on the full sets.

    A null or empty text has no set: 0 shingles, linked with nothing. A null key is linked with nothing and kept.
    Repeated rows get equal results; extra columns are ignored; an empty table gives no row.
    """
    sig = scratch.write(_signatures(docs, text, key, width, bands, rows), batch_rows=1000)
    some = sig.where("sig is not null and id is not null")
    classes = scratch.write(some.groupBy("sig").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")))

    def emit(batches):
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
            ids, n = np.repeat(batch.column(0).to_numpy(), bands), np.repeat(batch.column(1).to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids), pa.array(n)], names=["key", "id", "n"])

    every = classes.select("rep", "n", "keys").mapInArrow(tidy(emit), "key long, id long, n long")
    shared = every.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("hub")).where("m > 1").select(F.col("key").alias("k"), "m", "hub")
    members = scratch.write(every.join(shared, F.col("key") == F.col("k")).select("key", "m", "hub", "id", "n"))
    scratch.free_shuffles()
    ids = members.select("id").distinct()
    named = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    sets = scratch.write(_sets(named.join(ids, "id", "left_semi"), width).dropDuplicates(["id"]), batch_rows=1000)
    scratch.free_shuffles()

    tested = scratch.write(members.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    links = scratch.write(_linked(tested, sets, percent), batch_rows=1000)
    parts = scratch.write(connected_components(links, scratch))
    scratch.free_shuffles()
    grouped = members.where("m > 2").join(parts, "id", "left").select("key", "m", "id", "n", F.coalesce("component", "id").alias("c"))
    spans = grouped.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1").select("key")
    open_ = scratch.write(grouped.join(spans, "key"))
    few = open_.where(F.col("m") <= small)
    left, right = few.select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca")), few.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"))
    fits = f"a < b and ca != cb and 100 * least(na, nb) >= {percent} * greatest(na, nb)"
    across = scratch.write(left.join(right, "key").where(fits).select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
    more = scratch.write(_linked(across, sets, percent).union(_block_links(open_.where(F.col("m") > small), sets, percent, block)), batch_rows=1000)
    if not more.isEmpty():
        parts = scratch.write(connected_components(links.union(more), scratch))
    scratch.drop(members, sets, tested, across, open_)
    scratch.free_shuffles()

    found = classes.select("sig", "rep").join(parts.withColumnRenamed("id", "rep"), "rep", "left").select(F.col("sig").alias("s"), F.coalesce("component", "rep").alias("component"))
    out = sig.select("id", "n", "sig").join(found, F.col("sig") == F.col("s"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, scratch: Scratch, key: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that stay: one document of each component; the columns of docs."""
    gone = near_duplicates(docs, scratch, key=key, **options).where("not kept").select(F.col(key).alias("gone")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).cast("long").alias("k"))
    return rows.join(gone, F.col("k") == F.col("gone"), "left_anti").select("row.*")
