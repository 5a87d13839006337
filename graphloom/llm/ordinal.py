"""Quality classifier: ordinal cumulative-link regression over hashed text."""

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .worker import slices, tidy

#: Letters that stand for kinds of characters in a word's shape.
_UPPER, _LOWER, _DIGIT = "A", "a", "0"


def _shape(word: str) -> str:
    """The kinds of a word's characters, runs as one: 'Abc!!' is 'Aa!'."""
    out = ""
    for c in word[:64]:
        k = _LOWER if c.islower() else _UPPER if c.isupper() else _DIGIT if c.isdigit() else c if not c.isalnum() else _LOWER
        if not out.endswith(k):
            out += k
    return out


class Hashed:
    """Features of a text: each distinct word once, with its first four and five letters, and how often each shape and
    repetition occurs, by halving steps. All are hashed into `size` weights, alike on every machine."""

    def __init__(self, size: int, bound: int = 300_000):
        self.size, self.bound = size, bound
        self.words: dict[str, tuple[tuple[int, ...], str]] = {}

    def _hash(self, s: str) -> int:
        return zlib.crc32(s.encode("utf-8", "surrogatepass")) % self.size

    def of(self, text: str | None) -> np.ndarray:
        ws = (text or "").split()
        if len(self.words) > self.bound:
            self.words.clear()
        known, counts, seen = self.words, {}, {}
        for w in ws:
            seen[w] = seen.get(w, 0) + 1
        out: set[int] = set()
        for w, n in seen.items():
            got = known.get(w)
            if got is None:
                bare = w.strip(".,;:!?\"'()").lower()
                got = known[w] = (tuple(self._hash(x) for x in ("w:" + bare, *(f"p:{bare[:k]}" for k in (4, 5) if len(bare) > k))), _shape(w))
            out.update(got[0])
            counts[got[1]] = counts.get(got[1], 0) + n
        total = max(len(ws), 1)
        for shape, n in counts.items():
            out.add(self._hash(f"s:{shape}:{min(9, int(-math.log2(n / total)))}"))
        out.add(self._hash(f"n:{int(math.log2(total))}"))
        out.add(self._hash(f"d:{int(10 * len(seen) / total)}"))
        same = sum(a == b for a, b in zip(ws, ws[1:]))
        out.add(self._hash(f"r:{int(10 * same / total)}"))
        return np.fromiter(sorted(out), dtype=np.int64, count=len(out))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """P(grade > k) = sigmoid(w . x - t_k) with t_0 < t_1 < ...: one weight vector, ordered thresholds."""

    def __init__(self, size: int, grades: int):
        self.size, self.grades = size, grades
        self.w = np.zeros(size, np.float32)
        self.t0, self.gaps = 0.0, np.zeros(grades - 2)  # t_k = t0 + sum of exp(gaps)

    def thresholds(self) -> np.ndarray:
        return self.t0 + np.concatenate(([0.0], np.cumsum(np.exp(self.gaps))))

    def score(self, x: np.ndarray) -> float:
        return float(self.w[x].sum())

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0, 1, ...: a column for each threshold."""
        return _sigmoid(np.asarray(score)[:, None] - self.thresholds()[None, :])

    def fit(self, xs: list[np.ndarray], ys: np.ndarray, rounds: int, rate: float, decay: float, weights: np.ndarray, seed: int) -> "Model":
        rng = np.random.default_rng(seed)
        grad2 = np.full(self.size, 1e-6)
        head2 = np.full(self.grades - 1, 1e-6)
        start = np.array([max(1e-3, min(1 - 1e-3, np.average(ys > k, weights=weights))) for k in range(self.grades - 1)])
        t = -np.log(start / (1 - start))
        self.t0, self.gaps = float(t[0]), np.log(np.maximum(np.diff(t), 0.1))
        for _ in range(rounds):
            for i in rng.permutation(len(xs)):
                x, y = xs[i], int(ys[i])
                s, cut = float(self.w[x].sum()), self.thresholds()
                above = _sigmoid(s - cut)
                # gradient of -log(P(> y - 1) - P(> y)) in the score and the thresholds
                hi = above[y - 1] if y > 0 else 1.0
                lo = above[y] if y < self.grades - 1 else 0.0
                p = max(hi - lo, 1e-9)
                g = np.zeros(self.grades - 1)
                if y > 0:
                    g[y - 1] += hi * (1 - hi) / p
                if y < self.grades - 1:
                    g[y] -= lo * (1 - lo) / p
                g *= weights[i]
                step = -g.sum() + decay * self.w[x]
                grad2[x] += step * step
                self.w[x] -= (rate * step / np.sqrt(grad2[x])).astype(np.float32)
                down = np.cumsum(g[::-1])[::-1]  # t_k moves all thresholds from k on
                dgap = down[1:] * np.exp(self.gaps)
                d = np.concatenate(([down[0]], dgap))
                head2 += d * d
                move = 0.3 * rate * d / np.sqrt(head2)
                self.t0 -= float(move[0])
                self.gaps = np.clip(self.gaps - move[1:], -5, 5)
        return self


def grade(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 poor, 2 good."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).otherwise(2)


def _features(docs: DataFrame, size: int) -> DataFrame:
    def run(batches):
        hashed = Hashed(size)
        for b in slices(batches, rows=512):
            x = [hashed.of(t).astype("<i4").tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], names=["id", "y", "x"])

    return docs.mapInArrow(tidy(run), "id long, y int, x binary")


def rated_documents(docs: DataFrame, labels: DataFrame, sample: int = 20_000, text: str = "text", key: str = "doc_id", seed: int = 11) -> DataFrame:
    """(id, y, text) of at most `sample` labelled documents, those with the least hashes of their keys. The labels are
    cut first, so that they can be broadcast and no text is shuffled."""
    ys = labels.where("quality is not null and toxic is not null").select(F.col(key).cast("long").alias("id"), grade(F.col("quality"), F.col("toxic")).alias("y"))
    picked = ys.where("id is not null").groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample)
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id").select("id", "y", "text")


def fit(
    rated: DataFrame, grades: int = 3, size: int = 1 << 18, rounds: int = 20, rate: float = 0.3,
    decay: float = 1e-5, least_z: float = 6.0, least_rows: int = 3, seed: int = 11,
) -> Model:
    """A model of rated(id, y, text), y from 0 to grades - 1 (others are left out), fitted on the driver: give it a
    bounded sample. Grades weigh by the root of their inverse frequency. Only features get a weight that stand in
    `least_rows` rows and move some tail by `least_z` standard errors."""
    some = rated.where(f"id is not null and y >= 0 and y < {grades}")
    rows = _features(some.select("id", F.col("y").cast("int").alias("y"), "text"), size).toArrow().sort_by("id")
    model = Model(size, grades)
    if not rows.num_rows:
        return model
    xs = [np.frombuffer(x, "<i4").astype(np.int64) for x in rows.column("x").to_pylist()]
    ys = rows.column("y").to_numpy().astype(int)
    share = np.bincount(ys, minlength=grades) / len(ys)
    weights = 1 / np.sqrt(np.maximum(share[ys], 1e-6) * grades)
    flat, per = np.concatenate(xs), np.repeat(ys, [len(x) for x in xs])
    rows_with = np.bincount(flat, minlength=size)
    told = np.zeros(size, bool)
    for k in range(grades - 1):
        p = (ys > k).mean()
        above = np.bincount(flat, weights=per > k, minlength=size)
        told |= np.abs(above - rows_with * p) >= least_z * np.sqrt(np.maximum(rows_with * p * (1 - p), 1e-9))
    told &= rows_with >= least_rows
    return model.fit([x[told[x]] for x in xs], ys, rounds, rate, decay, weights, seed)


def grade_texts(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """(key, expected_grade, p_above_0, p_above_1, ..., selected) of every row of docs.

    selected: every tail probability reaches `least` (with three grades: neither toxic nor poor). Null and empty texts
    have no words and are graded by their length features. Repeated rows get equal results, extra columns are ignored,
    an empty table gives no row. One pass without a shuffle; the model's weights are of fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"p_above_{k}" for k in range(model.grades - 1)]

    def run(batches):
        m = shared.value
        hashed = Hashed(m.size)
        for b in slices(batches, rows=512):
            tails = m.tails([m.score(hashed.of(t)) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(tails.sum(axis=1)), *(pa.array(c) for c in tails.T), pa.array((tails >= least).all(axis=1))],
                names=["id", "grade", *names, "selected"],
            )

    named = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    return named.mapInArrow(tidy(run), "id long, grade double, " + ", ".join(f"{n} double" for n in names) + ", selected boolean").toDF(key, "expected_grade", *names, "selected")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return grade_texts(docs, fit(rated_documents(docs, labels)))
