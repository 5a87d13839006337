"""Near duplicates against brute force on all pairs."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import minhash
from graphloom.llm.common import Scratch, connected_components


def shingles(t, width):
    ws = (t or "").encode().lower().split()
    return {tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set()


def brute(rows, width, percent=80):
    sets = {k: shingles(t, width) for k, t in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ks = sorted(sets)
    for i, a in enumerate(ks):
        for b in ks[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((k, len(sets[k]), find(k), find(k) == k) for k in ks)


def corpus():
    r = random.Random(2)
    words = ["w%d" % i for i in range(60)] + ["É", "é", "A", "a\x1f"]
    rows = []
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.choice([1, 2, 3, 8, 40, 300]))]
        for _ in range(r.choice([1, 2, 6])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 3, 8])):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((len(rows), r.choice([" ", "\t", "\n "]).join(t)))
    big = [r.choice(words) for _ in range(90)]  # a group in which many pairs are near the threshold
    for _ in range(40):
        t = list(big)
        for _ in range(r.randrange(7)):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((len(rows), " ".join(t)))
    return rows + [(900, None), (901, ""), (902, "  \n"), (903, "One"), (904, "oNE"), (905, "x " * 30000)]


def test_components_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, 7) for k, t in rows], "doc_id long, text string, n long").repartition(3)
    for width in (2, 5):
        for small, block in ((32, 192), (2, 7)):  # with small blocks, most buckets are split
            got = minhash.near_duplicates(docs, Scratch(spark), width=width, small=small, block=block)
            assert sorted(tuple(r) for r in got.collect()) == brute(rows, width)


def test_repeated_rows_null_keys_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (3, "A b  c"), (None, None)], "doc_id long, text string")
    got = minhash.near_duplicates(docs, Scratch(spark), width=2).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (3, 2, 1, False), (None, 0, None, True)], key=repr)
    assert minhash.near_duplicates(docs.limit(0), Scratch(spark)).count() == 0
    kept = minhash.deduplicated(docs.withColumn("gone", docs.doc_id), Scratch(spark), width=2)
    assert kept.columns == ["doc_id", "text", "gone"] and kept.count() == 4


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 1 << 40), min_size=1, max_size=400), st.integers(3, 40))
def test_sketches_fill_every_coordinate_and_ignore_order(xs, t):
    a = np.array(sorted(xs), dtype=np.uint64)
    one = minhash.sketches([a], t)
    both = minhash.sketches([a[:1], a[::-1], a], t)
    assert (one != minhash._NONE).all() and (both[1] == one[0]).all() and (both[2] == one[0]).all()


def test_sketches_estimate_similarity():
    r = np.random.default_rng(0)
    x = r.integers(0, 1 << 62, 1000).astype(np.uint64)
    s = minhash.sketches([x[:900], x[100:]], 400)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.08


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 150: 100, 200: 100}
