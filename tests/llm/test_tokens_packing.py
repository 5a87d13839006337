"""Round trips and brute force for token ids and both packers."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import packing, token_output
from graphloom.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda s: t.encode(s, add_special_tokens=False).ids


ENCODER, LIBRARY = Encoder(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet=" \n\t\r\x0b\x1c\u3000 aZ9'é.,!日#s", max_size=60), st.text(max_size=60)))
@example("<|endoftext|> a")
@example("a <|endoftext|> b\n<|endoftext|><|endoftext|>")
@example("<|endoftext|")
@example(" " * 50000 + "x")
@example("a" * 50000)
def test_ids_are_those_of_the_tokenizers_library(s):
    assert np.frombuffer(ENCODER.ids([s])[0], "<u4").tolist() == LIBRARY.encode(s, add_special_tokens=False).ids


def rebuilt(rows, plain, texts):
    got = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == len(got.setdefault(r["doc_id"], [])) and r["length"] == len(ids)
        got[r["doc_id"]] += ids
    assert got == {k: plain(t or "") + [1] for k, t in texts.items()}


def test_pack_round_trip(spark, plain):
    random.seed(3)
    texts = {i: " ".join(random.choice(["alpha", "beta", "x", "Ünï", "\n"]) for _ in range(random.choice([0, 1, 30, 900, 5000]))) for i in range(60)} | {900: None, 901: "", 902: "a" * 30000}
    docs = spark.createDataFrame([(k, t, 5) for k, t in texts.items()], "doc_id long, text string, length int").repartition(3)
    rows = packing.pack(docs, PATH, seq_len=256).collect()
    rebuilt(rows, plain, texts)
    windows = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == windows.get(r["sequence_id"], 0)
        windows[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == 256 or n & (n - 1) == 0 for n in windows.values())
    assert sum(1 for n in windows.values() if n != 256) <= 3 * 8
    d = packing.pack(docs, PATH, seq_len=256).selectExpr("crc32(ids) c", "ids").collect()
    assert all(x.c == zlib.crc32(bytes(x.ids)) for x in d)
    assert packing.pack(docs.limit(0), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 150), max_size=80), st.integers(1, 6))
def test_packer_loses_nothing(lengths, most_open):
    p = packing.Packer(32, most_open)
    want = {}
    for i, n in enumerate(lengths):
        ids = np.arange(n, dtype="<u4").tobytes()
        want[i] = ids
        p.add(i, ids)
    p.finish()
    got = {i: b"" for i in want}
    fill = {}
    for doc, start, n, ids, total, seq, off in sorted(p.take(), key=lambda x: (x[0], x[1])):
        assert start * 4 == len(got[doc]) and n * 4 == len(ids) and total == lengths[doc]
        got[doc] += ids
        fill[seq] = fill.get(seq, 0) + n
    assert got == want and all(n & (n - 1) == 0 and 0 < n <= 32 for n in fill.values())
    assert sum(1 for n in fill.values() if n < 32) <= 5


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_each_piece_goes_where_the_squares_become_least(lengths):
    size = 32
    p = packing.Packer(size)
    levels = [0] * (size + 1)  # open windows by fill, kept by brute force
    for i, n in enumerate(x for length in lengths for x in [*[size] * (length // size), length % size] if x):
        before = sum(v * v for v in levels)
        options = []
        for f in [f for f in range(size, 0, -1) if levels[f] and f + n <= size] + [0]:
            after = levels.copy()
            if f:
                after[f] -= 1
            if f + n < size:
                after[f + n] += 1
            options.append((sum(v * v for v in after) - before, -f, after))
        levels = min(options)[2]
        p.add(i, np.zeros(n, "<u4").tobytes())
        assert p.levels.tolist() == levels


def test_packers_take_repeated_rows_and_null_keys(spark, plain):
    rows = [(None, "a b c"), (None, "a b c"), (7, "x y"), (7, "x y"), (8, "only <|endoftext|> here"), (None, None)]
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, offset int, sequence_id int").repartition(2)
    want = sorted([(k, tuple(plain(t or "") + [1])) for k, t in rows], key=repr)
    got = packing.pack(docs, PATH, seq_len=64).collect()
    pieces = sorted([(r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got if r.length == r.doc_tokens], key=repr)
    assert sum(r.length for r in got) == sum(len(x) for _, x in want) and set(pieces) <= set(want)
    segments = [(d, tuple(np.frombuffer(r.ids, "<u4")[a:b].tolist())) for r in token_output.packed_sequences(docs, PATH, seq_len=64).collect() for d, a, b in zip(r.doc_ids, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True)]
    assert sorted(segments, key=repr) == want


def test_binary_files(spark, plain, tmp_path):
    texts = {i: f"word {i} " * (10 * i) for i in range(12)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    packed = token_output.packed_sequences(docs, PATH, seq_len=64)
    files = token_output.write_binary(packed, f"file://{tmp_path}/out", seq_len=64)
    lines, segments = {}, []
    for f in files:
        ids = np.fromfile(tmp_path / "out" / f"{f.name}.ids.bin", "<u4").reshape(-1, 64)
        ends = np.fromfile(tmp_path / "out" / f"{f.name}.cu_seqlens.bin", "<u4")
        resets = np.fromfile(tmp_path / "out" / f"{f.name}.position_starts.bin", "<u4")
        assert len(ids) == f.sequences and len(ends) == f.segments + f.sequences and len(resets) == f.segments
        for line in ids:
            lines[line.tobytes()] = lines.get(line.tobytes(), 0) + 1
        at = 0
        for line in ids:
            cut = [0]
            while at + len(cut) < len(ends) and ends[at + len(cut)]:
                cut.append(int(ends[at + len(cut)]))
            segments += [tuple(line[a:b].tolist()) for a, b in zip(cut, cut[1:])]
            at += len(cut)
    want = {}
    for r in packed.collect():
        want[bytes(r.ids)] = want.get(bytes(r.ids), 0) + 1
    assert lines == want
    assert sum(map(len, segments)) == sum(len(plain(t)) + 1 for t in texts.values())
    with pytest.raises(Exception, match="exists"):
        token_output.write_binary(packed, f"file://{tmp_path}/out", seq_len=64)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit_decreasing_against_brute_force(lengths):
    want = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [b for b in want if b[0] + lengths[i] <= 40]
        if fits:
            b = max(fits, key=lambda b: b[0])
            b[0] += lengths[i]
            b[1].append(i)
        else:
            want.append([lengths[i], [i]])
    got = token_output.best_fit_decreasing(lengths, 40)
    assert sorted(i for b in got for i in b) == list(range(len(lengths)))
    assert sorted(sum(lengths[i] for i in b) for b in got) == sorted(b[0] for b in want)


def test_packed_sequences_round_trip(spark, plain):
    texts = {1: "a b c " * 700, 2: None, 3: "", 4: "x y", 5: "x y", 6: "日本 " * 300}
    docs = spark.createDataFrame([(k, t, "z") for k, t in texts.items()], "doc_id long, text string, ids string").repartition(2)
    got = {k: {} for k in texts}
    for r in token_output.packed_sequences(docs, PATH, seq_len=128, block_tokens=500).collect():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == 128 and ids[r["n_tokens"] :] == [0] * (128 - r["n_tokens"])
        cu = r["cu_seqlens"]
        assert cu[0] == 0 and cu[-1] == r["n_tokens"] and cu[:-1] == r["position_starts"]
        for d, s, a, b in zip(r["doc_ids"], r["doc_starts"], cu, cu[1:]):
            got[d][s] = ids[a:b]
    assert {k: [x for _, p in sorted(v.items()) for x in p] for k, v in got.items()} == {k: plain(t or "") + [1] for k, t in texts.items()}
    assert token_output.packed_sequences(docs.limit(0), PATH).count() == 0
