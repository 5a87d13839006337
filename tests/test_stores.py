"""Parquet store, endpoint, remote store and streams."""

import urllib.error
import urllib.parse
import urllib.request

import pytest

import workloads
from graphloom import terms as R
from graphloom.dataset import Dataset
from graphloom.engine import query
from graphloom.operators.update import update
from graphloom.server import Endpoint, serve
from graphloom.sources import registry, results
from graphloom.sources.store import ParquetStore, RemoteStore
from graphloom.streaming import quads as stream
from graphloom.terms import Term, literal

EX = "http://example.org/"
I = lambda n: Term(1, EX + n)  # noqa: E731, E741


def start(spark):
    return Dataset.of(spark, [(I("a"), EX + "p", literal(i), "") for i in range(5)] + [(I("a"), EX + "q", literal("x", lang="en"), ""), (I("b"), EX + "p", I("a"), EX + "g")])


def test_parquet_store(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "s"), buckets=4)
    assert store.version() == 0
    ds = start(spark)
    ds.namespaces.bind("ex", EX)
    assert store.save(ds) == 1
    got = store.load()
    assert got.namespaces.by["ex"] == EX and got.graph().count(p=EX + "p") == 5 and len(got.graph(EX + "g")) == 1
    plan = got.triples("", p=EX + "q")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(b" in plan
    assert query(got, f"SELECT ?o {{ <{EX}a> <{EX}q> ?o }}").count() == 1
    assert store.save(update(got, f"DELETE WHERE {{ ?s <{EX}q> ?o }}")) == 2
    assert store.load().graph().count() == 5 and store.load(1).graph().count() == 6
    with pytest.raises(PermissionError):
        ParquetStore(spark, str(tmp_path / "s"), read_only=True).save(ds)


def test_endpoint_and_remote_store(spark):
    endpoint = Endpoint(start(spark))
    server = serve(endpoint)
    url = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        remote = RemoteStore(spark, url + "/query", url + "/update")
        assert remote.count(I("a")) == 6 and remote.triples(p=EX + "q").first().o.lang == "en" and remote.triples(g=EX + "g").count() == 1
        remote.add([(I("n"), EX + "p", literal("new\n"), ""), (I("n"), EX + "p", literal(1), EX + "h")])
        assert remote.triples(I("n")).first().o.v == "new\n" and remote.count(I("n"), g=EX + "h") == 1 and remote.triples(I("n"), EX + "p", literal("new\n")).count() == 1
        remote.remove(I("n"))
        assert remote.count(I("n")) == 0 and remote.dataset().quads.count() == 8
        q = urllib.parse.urlencode({"query": f"SELECT ?o {{ <{EX}a> <{EX}p> ?o }}"})

        def get(path, accept="*/*", **more):
            r = urllib.request.Request(url + path, headers={"Accept": accept}, **more)
            with urllib.request.urlopen(r) as x:
                return x.status, x.headers.get_content_type(), x.read().decode()

        assert len(results.from_xml(get(f"/query?{q}", "application/sparql-results+xml")[2])[1]) == 5
        assert get(f"/query?{q}", "text/csv")[2].startswith("o\r\n") and get(f"/query?{q}")[1] == "application/sparql-results+json"
        assert get("/query", data=q.encode())[0] == 200
        c = urllib.parse.urlencode({"query": f"CONSTRUCT {{ ?s ?p ?o }} WHERE {{ ?s ?p ?o }}", "default-graph-uri": EX + "g"})
        assert len(registry.parse(get(f"/query?{c}", "text/turtle")[2], "turtle")) == 1
        assert "true" in get("/query?" + urllib.parse.urlencode({"query": "ASK { ?s ?p ?o }"}))[2]
        for path, code, kw in (("/query?query=SELECT", 400, {}), ("/query", 400, {}), ("/nope", 404, {}), (f"/query?{q}", 406, {"accept": "image/png"}), ("/update?update=x", 405, {}), ("/query", 415, {"data": b"x"})):
            if "data" in kw:
                r = urllib.request.Request(url + path, data=b"x", headers={"Content-Type": "text/html"})
            else:
                r = urllib.request.Request(url + path, headers={"Accept": kw.get("accept", "*/*")})
            with pytest.raises(urllib.error.HTTPError) as e:
                urllib.request.urlopen(r)
            assert e.value.code == code, path
        assert Endpoint(start(spark), writable=False).respond("POST", "/update", {"Content-Type": "application/sparql-update"}, b"CLEAR ALL")[0] == 403
    finally:
        server.shutdown()


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.nq").write_text("<a:s> <a:p> \"1\" .\nbad\n<a:s> <a:q> <a:o> <a:g> .\n")
    (tmp_path / "in" / "2.nq").write_text('<a:t> <a:p> "e\\n" .\n')
    seen = []
    q = stream.for_each(stream.stream_lines(spark, str(tmp_path / "in")), lambda b, n: seen.extend(registry.collected(b)), str(tmp_path / "c1"))
    q.awaitTermination()
    assert sorted(x[2].v for x in seen) == ["1", "a:o", "e\n"] and q.exception() is None
    stream.append_to(stream.stream_lines(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    (tmp_path / "in" / "3.nq").write_text("<a:u> <a:p> <a:o> .\n")
    stream.append_to(stream.stream_lines(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4

    def fails(b, n):
        raise ValueError("handler")

    bad = stream.for_each(stream.stream_lines(spark, str(tmp_path / "in")), fails, str(tmp_path / "c3"))
    with pytest.raises(Exception, match="handler"):
        bad.awaitTermination()
    right = spark.createDataFrame([((1, "a:s", "", "", ""), "name")], f"s {R.TERM_DDL}, name string")
    out = stream.matching(stream.stream_lines(spark, str(tmp_path / "in")), "a:p", right).writeStream.format("memory").queryName("matched").trigger(availableNow=True).start()
    out.awaitTermination()
    assert spark.table("matched").count() == 1
    n = stream.counts(stream.stream_lines(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    n.awaitTermination()
    assert {(r.g, r.p): r.n for r in spark.table("counted").collect()} == {("", "a:p"): 3, ("a:g", "a:q"): 1}


def test_lookups_open_their_buckets_only(spark, tmp_path):
    kept = ParquetStore(spark, str(tmp_path / "pruned"))
    kept.save(Dataset(spark, workloads.plain_triples(spark, 400, 20)))
    g = kept.load().graph()
    value = R.Term(2, "value_7", R.STRING)
    for name, df in (("sb", g.triples(s=R.Term(1, "http://example.org/s7"))), ("b", g.triples(p="http://example.org/p7")), ("ob", g.triples(o=value))):
        assert df.count() == (20 if name == "b" else 1)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert f"isnotnull({name}#" in plan and "PartitionFilters: [" in plan and "Exchange" not in plan


def test_film_workload(spark):
    ds = Dataset(spark, workloads.films(spark, 1500).cache())
    got = {name: query(ds, workloads.PREFIXES + text) for name, text in workloads.FILM_QUERIES.items()}
    assert got["top_ten"].count() == 10 and got["per_genre"].count() == 20 and got["optional_rating"].count() == 100
    assert {r.title["v"] for r in got["by_director"].collect()} == {r.title["v"] for r in query(ds, workloads.PREFIXES + "SELECT ?title { ?f ff:directed_by ?d ; rdfs:label ?title . ?d rdfs:label 'Director 0'@en }").collect()}
    assert got["construct"].count() == 100 and 2 <= got["actors_in_film"].count() <= 5
