"""Ordinal regression by held-out accuracy; language-model scores against brute force."""

import math
import random
from collections import Counter

import numpy as np

from graphloom.llm import lm, ordinal
from graphloom.llm.common import Scratch


def graded(n, seed):
    r = random.Random(seed)
    plain = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        y = r.choice([0, 1, 2, 2])
        t = [r.choice(plain) for _ in range(r.randrange(20, 120))]
        if y == 0:
            for _ in range(3):
                t[r.randrange(len(t))] = r.choice(["nasty", "vileness", "vilest"])
        if y == 1:
            t = [w + "!!" if r.random() < 0.5 else w for w in t]
        rows.append((i, y, " ".join(t)))
    return rows


def test_held_out_accuracy(spark):
    model = ordinal.fit(spark.createDataFrame(graded(1500, 1), "id long, y int, text string").repartition(3), size=1 << 16)
    t = model.thresholds()
    assert (np.diff(t) > 0).all()
    test = graded(600, 2)
    docs = spark.createDataFrame([(i, t, 0, "s") for i, _, t in test] + [(9000, None, 0, "s"), (9001, "", 0, "s"), (None, "w1", 0, "s")], "doc_id long, text string, grade int, selected string")
    got = {r.doc_id: r for r in ordinal.grade_texts(docs, model).collect()}
    assert len(got) == 603
    right = sum((got[i].p_above_0 >= 0.5) + (got[i].p_above_1 >= 0.5) == y for i, y, _ in test)
    assert right >= 0.95 * len(test)
    assert all(got[i].selected == (got[i].p_above_0 >= 0.5 and got[i].p_above_1 >= 0.5) for i, _, _ in test)
    assert all(abs(r.expected_grade - r.p_above_0 - r.p_above_1) < 1e-9 and r.p_above_0 >= r.p_above_1 for r in got.values())
    assert ordinal.grade_texts(docs.limit(0), model).count() == 0


def test_fit_without_rows(spark):
    model = ordinal.fit(spark.createDataFrame([], "id long, y int, text string"))
    assert not model.w.any()


def test_gradients():
    """One step down the loss from each start lowers it."""
    xs = [np.array([0, 1]), np.array([1, 2]), np.array([2, 3]), np.array([], dtype=np.int64)]
    ys = np.array([0, 1, 2, 2])

    def loss(m):
        tails = np.hstack([np.ones((4, 1)), m.tails([m.score(x) for x in xs]), np.zeros((4, 1))])
        return -np.log(tails[np.arange(4), ys] - tails[np.arange(4), ys + 1]).sum()

    m, last = ordinal.Model(4, 3).fit(xs, ys, 1, 0.05, 0, np.ones(4), 0), None
    for rounds in (2, 10, 60):
        m = ordinal.Model(4, 3).fit(xs, ys, rounds, 0.05, 0, np.ones(4), 0)
        assert last is None or loss(m) < last
        last = loss(m)


def brute(rows, order, penalty, least):
    docs = [(k, [w.decode() for w in (t or "").encode().lower().split()]) for k, t in rows]
    counts = Counter(tuple(ws[i : i + n]) for _, ws in docs for n in range(1, order + 1) for i in range(len(ws) - n + 1))
    total = sum(len(ws) for _, ws in docs)
    out = []
    for k, ws in docs:
        s = 0.0
        for i, w in enumerate(ws):
            full = min(i, order - 1)
            for n in range(full, -1, -1):
                gram = tuple(ws[i - n : i + 1])
                if n == 0 or counts[gram] >= least:
                    s += math.log(counts[gram] / (counts[gram[:-1]] if n else total)) + (full - n) * math.log(penalty)
                    break
        out.append((k, len(ws), round(s, 6), round(s / len(ws), 6) if ws else None))
    return sorted(out, key=repr)


def test_scores_match_brute_force(spark):
    r = random.Random(8)
    rows = [(i, r.choice([" ", "\n"]).join(r.choice("a A b c d é E".split()) + r.choice(["", "", "x"]) for _ in range(r.choice([1, 2, 3, 30])))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "a b c"), (102, rows[5][1]), (102, rows[5][1]), (103, "the " * 5000)]
    docs = spark.createDataFrame([(k, t, 1, "n") for k, t in rows], "doc_id long, text string, n int, level string").repartition(3)
    for order, chunk, bucket in ((1, 50, 10), (2, 50, 40), (3, 37, 1000), (4, 10**6, 30)):
        got = lm.backoff_scores(docs, Scratch(spark), order=order, chunk_words=chunk, bucket_words=bucket).collect()
        assert sorted([(x[0], x[1], round(x[2], 6) + 0.0, None if x[3] is None else round(x[3], 6)) for x in got], key=repr) == brute(rows, order, 0.4, 2)
    rounded = lambda df: sorted([(x[0], x[1], round(x[2], 6) + 0.0, None if x[3] is None else round(x[3], 6)) for x in df.collect()], key=repr)
    assert rounded(lm.scores_by_rows(docs, Scratch(spark))) == brute(rows, 3, 0.4, 2)
    assert lm.backoff_scores(docs.limit(0), Scratch(spark)).count() == lm.scores_by_rows(docs.limit(0), Scratch(spark)).count() == 0
