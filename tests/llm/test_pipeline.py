"""The pipeline against brute force on a small corpus, and the registered queries' SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import queries, rules
from graphloom.llm.queries import TOKENIZER

from .test_minhash import brute as components
from .test_rules_mixing import plain as figures

SF = "/root/testdata/sf0.001"


def corpus():
    r = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdgk" for b in "aeiou" for c in "lmnrst"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n)) + "."
    passage = prose(120)
    rows = []
    for i in range(60):
        rows.append((i, prose(r.choice([30, 150, 400])) + (" " + passage + " " + prose(40) if i % 9 == 0 else ""), "en", f"src{i % 4}"))
    for i in range(8):  # near copies
        t = rows[i][1].split()
        t[len(t) // 2] = "changed"
        rows.append((100 + i, " ".join(t), "en", "src0"))
    rows += [(200, "short one", "en", "src1"), (201, "### $$$ %%%\n" * 20, "en", "src1"), (202, None, "en", None), (203, "again and " * 50, "en", "src2"), (204, rows[3][1], "fr", "src3")]
    return rows


def without_repeats(texts, length=50):
    """Texts without the words of 50-word strings that start twice, white space kept."""
    data = {k: [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] for k, t in texts.items()}
    words = {k: [texts[k][a:b] for a, b in spans] for k, spans in data.items()}
    seen = Counter(tuple(w[i : i + length]) for w in words.values() for i in range(len(w) - length + 1))
    out = {}
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        at, left = 0, ""
        for i, (a, b) in enumerate(data[k]):
            if gone[i] and (i == 0 or not gone[i - 1]):
                left += texts[k][at:a]
            if gone[i]:
                at = b
        out[k] = left + texts[k][at:]
    return out


def test_against_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    judged = {r.doc_id: r.text for r in rules.clean(docs).collect()}
    assert not any(figures(t)[-1] for t in judged.values()) and {200, 201, 202, 203}.isdisjoint(judged)
    assert set(judged) == {k for k, t, *_ in rows if k < 200 or k == 204}
    kept = {k: judged[k] for k, _, _, first in components(sorted(judged.items()), 5) if first}
    assert 204 not in kept and len(kept) < len(judged)
    want = without_repeats(kept)
    stage = docs
    for name, f in corpus_pipeline.STAGES[:3]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns, name
    assert {r.doc_id: (r.text, r.n_chars) for r in stage.collect()} == {k: (t, len(t)) for k, t in want.items()}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    plain = Tokenizer.from_file(TOKENIZER)
    ids = {k: plain.encode(t, add_special_tokens=False).ids + [1] for k, t in want.items()}
    pieces: dict = {}
    for p in out:
        pieces.setdefault(p.doc_id, []).append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
    for k, parts in pieces.items():  # every copy is whole
        at = Counter(i for s, p in parts for i in range(s, s + len(p)))
        assert set(at) == set(range(len(ids[k]))) and len(set(at.values())) == 1 and at[0] in (1, 2)
        assert all(ids[k][s : s + len(p)] == p for s, p in parts)
    assert set(pieces) <= set(want)


CLASHING = ["row", "k", "id", "th", "marks", "q_text", "m_key", "m_shards", "gone", "left", "offset", "sequence_id", "r_key"]


def test_empty_tables_repeated_rows_null_keys_and_clashing_columns(spark, tmp_path):
    r = random.Random(4)
    prose = lambda n: " ".join(r.choice("alpha beta gamma delta lorem ipsum dolor sit amet kappa".split()) + str(r.randrange(900)) for _ in range(n)) + "."
    rows = [(i, prose(60), "en", f"s{i % 2}") for i in range(12)] + [(None, prose(70), "en", None), (None, prose(80), "en", "s0"), (None, prose(80), None, None), (40, None, "en", "s0"), (41, "", "en", "s1")]
    rows += [rows[3], rows[3], (None, rows[12][1], "en", None)]  # copies of a keyed row and of one without a key
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    for name, data in (("some", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame([(*x, len(x[1] or ""), *CLASHING) for x in data], schema).repartition(2).write.parquet(str(folder / "documents.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        for stage, f in corpus_pipeline.STAGES[:4]:
            docs = f(spark, docs, str(folder))
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHING], stage
            assert all(all(x[c] == c for c in CLASHING) for x in docs.collect()), stage
        out = corpus_pipeline.run(spark, str(folder)).collect()
        assert {x.doc_id for x in out} <= {*range(12), None} and bool(out) == bool(data)
    whole = {x.doc_id for x in out}
    assert not whole


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    got = con.execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in got.description]
    order = sorted(cols)
    assert order == sorted(df.columns)
    assert sorted(repr(tuple(r[c] for c in order)) for r in df.collect()) == sorted(repr(tuple(r[cols.index(c)] for c in order)) for r in got.fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs_over_the_whole_table(spark, name):
    n = {"pages": 50, "embeddings": 500}.get({"op2_html_extraction": "pages", "op4_embedding_dedup": "embeddings"}.get(name), 200)
    rows = queries.QUERIES[name](spark, SF).count()
    assert rows == n or name in ("op3_token_output", "op5_packing") and rows > 0
