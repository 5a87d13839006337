"""Near vectors against brute force."""

import numpy as np
import pytest

from graphloom.llm import embedding
from graphloom.llm.common import Scratch


def brute(rows, cosine=0.95):
    ok = {}
    for i, (k, v) in enumerate(rows):
        if k is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.zeros(16)
        x[: len(v)] = v
        x /= np.abs(x).max()
        ok[i] = x / np.sqrt((x * x).sum())
    at = sorted(ok)
    x = np.array([ok[i] for i in at])
    near = x @ x.T >= cosine
    root = list(range(len(at)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in zip(*np.nonzero(near)):
        p, q = find(a), find(b)
        if p != q:
            lo, hi = sorted((p, q), key=lambda z: rows[at[z]][0])
            root[hi] = lo
    out = []
    for i, (k, _) in enumerate(rows):
        if i in ok:
            a = at.index(i)
            c = rows[at[find(a)]][0]
            out.append((k, int(near[a].sum()) - 1, c, k == c))
        else:
            out.append((k, 0, k, True))
    return sorted(out, key=repr)


def vectors():
    r = np.random.default_rng(1)
    rows, k = [], 0
    for _ in range(60):
        base = r.normal(size=16)
        for _ in range(r.choice([1, 1, 2, 8, 30])):
            rows.append((k, [float(np.float32(x)) for x in base + r.normal(size=16) * 0.28 * r.random()]))
            k += 1
    same = rows[3][1]
    rows += [(1000 + i, same) for i in range(40)] + [(2000, [2 * x for x in same])]
    nan = float("nan")
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [nan] + same[1:]), (3004, [None] + same[1:]), (3005, [float("inf")] + same[1:]), (None, same), (3006, same[:9]), (3007, [1e-30 * x for x in same]), (5, rows[5][1])]
    return rows


@pytest.mark.parametrize("block", [16, 2048])
def test_links_match_brute_force(spark, block):
    rows = vectors()
    df = spark.createDataFrame([(k, v, k, "x") for k, v in rows], "vec_id long, embedding array<double>, n long, list string").repartition(3)
    got = sorted([tuple(r) for r in embedding.near_vectors(df, Scratch(spark), block=block, margin=9.0).collect()], key=repr)
    assert got == brute(rows)


def test_recall_with_the_margin_in_use(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.vec_id): r.n_links for r in embedding.near_vectors(df, Scratch(spark)).collect() if r.vec_id is not None}
    want = {k: n for k, n, _, _ in brute(rows) if k is not None}
    assert sum(got.values()) >= 0.97 * sum(want.values()) and all(got[k] <= want[k] for k in want)


def test_empty(spark):
    df = spark.createDataFrame([(1, [0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in embedding.near_vectors(df, Scratch(spark)).collect()] == [(1, 0, 1, True)]
    assert embedding.near_vectors(df.limit(0), Scratch(spark)).count() == 0
