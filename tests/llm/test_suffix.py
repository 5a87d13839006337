"""Suffix arrays and repeated bytes against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import difference_cover, suffix
from graphloom.llm.common import Scratch


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(s):
    want = sorted(range(len(s)), key=lambda i: s[i:])
    assert suffix.suffix_array(np.array(s, dtype=np.int64)).tolist() == want


def windows(texts, length):
    return Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(x % 2 for x in b)), min_size=1, max_size=5), st.sampled_from([8, 11, 16]))
def test_repeated_starts(strings, length):
    seen = windows(strings, length)
    want = [[i for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1] for s in strings]
    assert [x.tolist() for x in suffix.repeated_starts([np.frombuffer(s, np.uint8) for s in strings], length)] == want
    wide = [np.frombuffer(s, np.uint8).astype(np.uint64) * np.uint64(1 << 60) for s in strings]
    assert [x.tolist() for x in suffix.repeated_starts(wide, length)] == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=80).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=4), st.sampled_from([13, 40, 1 << 20]))
def test_every_window_is_in_one_run_and_equal_windows_meet(texts, part):
    a = suffix.Anchors(12, 5)
    runs = list(a.of_texts([np.frombuffer(t, np.uint8) for t in texts], part))
    for i, t in enumerate(texts):
        got = sorted(w for r in runs if r[0] == i for w in range(r[2], r[2] + r[3]))
        assert got == list(range(max(0, len(t) - 11)))
    where = {}
    for r in runs:
        assert r[5] == texts[r[0]][r[2] : r[2] + r[3] + 11]
        for w in range(r[3]):
            where.setdefault(r[5][w : w + 12], []).append((r[1], r[4], (r[0], r[2])))
    for places in where.values():
        assert len({p[0] for p in places}) == 1
        if len(places) > 1 and len({p[2] for p in places}) == 1:
            assert places[0][1]  # two windows of one run: the anchor stands there twice


def brute(rows, length):
    data = [(k, (t or "").encode()) for k, t in rows]
    seen = windows([b for _, b in data], length)
    out = []
    for k, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def texts():
    r = random.Random(5)
    noise = lambda n: "".join(r.choice("abcdefgé ") for _ in range(n))
    shared, long_ = noise(70), noise(400)
    rows = [(i, noise(120) + (shared if i % 3 == 0 else "") + noise(50)) for i in range(30)]
    rows += [(100, long_), (101, long_[:200] + "X" + long_[200:]), (102, long_), (103, "ab" * 100), (104, "q" * 55), (105, ""), (106, None), (None, shared + "zz"), (107, noise(39)), (107, noise(39)), (108, noise(80) * 2)]
    return rows


def test_repeated_bytes(spark):
    rows = texts()
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n int").repartition(3)
    got = sorted([tuple(r) for r in suffix.repeated_bytes(docs, Scratch(spark), length=40, gram=16).collect()], key=repr)
    assert got == brute(rows, 40)
    assert suffix.repeated_bytes(docs.limit(0), Scratch(spark), length=40, gram=16).count() == 0


@pytest.fixture
def small_tasks(monkeypatch):
    """Every level of the distributed sort runs on a few hundred places, dealt to several tasks."""
    monkeypatch.setattr(difference_cover, "TASK_ROWS", 150)
    monkeypatch.setattr(difference_cover, "WINDOW", 64)
    monkeypatch.setattr(difference_cover, "ONE_TASK", 0)


@pytest.mark.usefixtures("interpreted")
@pytest.mark.parametrize("n,letters,depth", [(4, 1, 9), (200, 1, 20), (401, 2, 9), (402, 2, 28)])
def test_suffix_order(spark, small_tasks, n, letters, depth):
    r = random.Random(n)
    s = [r.randint(1, letters) for _ in range(n)]
    s[n // 2 : n // 2 + n // 4] = s[: n // 4]
    text = spark.createDataFrame(list(enumerate(s)), "pos long, sym long").repartition(3)
    got = [x.pos for x in difference_cover.suffix_order(text, n, depth, Scratch(spark)).orderBy("row").collect()]
    assert sorted(got) == list(range(n))
    assert [s[i : i + depth] for i in got] == sorted(s[i : i + depth] for i in range(n))


@pytest.mark.usefixtures("interpreted")
def test_suffix_order_ends_in_one_task(spark, small_tasks, monkeypatch):
    monkeypatch.setattr(difference_cover, "ONE_TASK", 200)
    s = [1 + i // 7 % 2 for i in range(500)]
    text = spark.createDataFrame(list(enumerate(s)), "pos long, sym long")
    got = [x.pos for x in difference_cover.suffix_order(text, 500, 500, Scratch(spark)).orderBy("row").collect()]
    assert got == sorted(range(500), key=lambda i: s[i:])


@pytest.mark.usefixtures("interpreted")
def test_large_shards_are_sorted_by_the_cluster(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SHARD", 100)
    monkeypatch.setattr(difference_cover, "TASK_ROWS", 3000)
    monkeypatch.setattr(difference_cover, "WINDOW", 1000)
    monkeypatch.setattr(difference_cover, "ONE_TASK", 500)
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted([tuple(r) for r in suffix.repeated_bytes(docs, Scratch(spark), length=40, gram=16).collect()], key=repr)
    assert got == brute(rows, 40)


def passages(rows, length):
    """Words left and words removed of each row, by brute force."""
    data = [(k, re.split(r"[\x20\x09-\x0D]+", t or "")) for k, t in rows]
    data = [(k, [w for w in ws if w]) for k, ws in data]
    seen = Counter(tuple(ws[i : i + length]) for _, ws in data for i in range(len(ws) - length + 1))
    out = []
    for k, ws in data:
        gone = [False] * len(ws)
        for i in range(len(ws) - length + 1):
            if seen[tuple(ws[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append((k, tuple(w for w, g in zip(ws, gone, strict=True) if not g), sum(gone)))
    return sorted(out, key=repr)


def word_texts():
    r = random.Random(8)
    words = [a + b + c for a in "bdkéß" for b in "aiou" for c in "lmnr"]
    prose = lambda n: [r.choice(words) for _ in range(n)]
    shared = prose(51)
    rows = [(i, " ".join([*prose(80), *(shared if i % 4 == 0 else []), *prose(30)])) for i in range(24)]
    rows += [(100, "  " + "\n\t".join(shared) + " "), (101, " ".join(shared[1:])), (102, " ".join(shared[2:])), (103, "x " * 70), (104, "\u00a0 " * 60), (105, ""), (106, None), (107, " "), (None, " ".join(shared))]
    return rows


@pytest.mark.usefixtures("interpreted")
def test_passages_of_fifty_words(spark, monkeypatch):
    rows = word_texts()
    docs = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    want = passages(rows, 50)
    assert {k for k, _, gone in want if gone} == {0, 4, 8, 12, 16, 20, 100, 101, 103, 104, None}
    for shard in (suffix.SHARD, 60):
        monkeypatch.setattr(suffix, "SHARD", shard)
        got = suffix.without_repeats(docs, Scratch(spark)).collect()
        left = [(r.doc_id, tuple(w for w in re.split(r"[\x20\x09-\x0D]+", r.text or "") if w)) for r in got]
        assert sorted(left, key=repr) == [(k, ws) for k, ws, _ in want]
        assert all(r.n_chars == len(r.text) for r in got if r.text and r.doc_id in (0, 100))
    whole = suffix.repeated_bytes(docs, Scratch(spark), words=50)
    assert sorted([(r.doc_id, r.n_passage_words) for r in whole.collect()], key=repr) == [(k, gone) for k, _, gone in want]


def test_word_hashes_follow_the_words():
    s = suffix.Symbols("word")
    t = "aa b\tcc\x0baa  \u00e9\u00a0x aa".encode()
    got = s.of(t).tolist()
    assert len(got) == 6 and got[0] == got[3] == got[5] and len(set(got)) == 4
    assert s.words(np.frombuffer(t, np.uint8), part=3).tolist() == got
    assert [t[a:b] for a, b in s.spans(t, [[1, 3], [4, 6]])] == [b"b\tcc", "\u00e9\u00a0x aa".encode()]
    assert len(s.of(b"")) == len(s.of(b" \n")) == 0


def test_without_repeats_keeps_rows_columns_and_characters(spark):
    rows = texts()
    docs = spark.createDataFrame([(k, t, "s", 0) for k, t in rows], "doc_id long, text string, marks string, n_chars long")
    got = suffix.without_repeats(docs, Scratch(spark), length=40, gram=16, unit="byte")
    assert got.columns == ["doc_id", "text", "marks", "n_chars"] and got.count() == len(rows)
    kept = {r.doc_id: r.text for r in got.collect()}
    assert kept[106] is None and kept[100] == ""
    assert sorted(r.text for r in got.collect() if r.doc_id == 107) == sorted(t for k, t in rows if k == 107)
