"""Readers and writers: round trips, term edge cases, errors."""

import pytest

from graphloom import terms as R
from graphloom.sources import jsonld, ntriples, rdfxml, registry, results, turtle
from graphloom.terms import Term, bnode, iri, literal, triple_term

EX = "http://example.org/"
I = lambda n: Term(1, EX + n)  # noqa: E731, E741


def edge_cases():
    s = I("s")
    lits = [
        literal("01", dt=R.INTEGER), literal(1), literal("1.0", dt=R.DECIMAL), literal(float("nan")), literal(float("-inf")), literal("x", lang="en"), literal("x", lang="EN"),
        literal("x"), literal("x", lang="ar", dir="rtl"), literal("v", dt=EX + "unknown"), literal('quo"te\\ back\nline\ttab\r é 😀'), literal("2020-01-01T10:00:00+02:00", dt=R.DATETIME),
        literal("2020-01-01", dt=R.DATE), literal("abc", dt=R.INTEGER), literal(True), literal(""), literal(1.5e10), literal("  spaces  "), literal("a<b>&amp;c"),
    ]
    out = [(s, EX + "p", o, "") for o in lits]
    out += [(bnode("b1"), EX + "q", bnode("b2"), ""), (bnode("b2"), R.TYPE, I("T"), ""), (s, R.TYPE, I("T"), ""), (s, EX + "self", s, "")]
    return out


def triple_terms():
    inner = triple_term(I("a"), EX + "b", literal('c"é'))
    return [(I("r"), R.REIFIES, inner, ""), (I("r"), EX + "says", triple_term(I("z"), EX + "y", inner), "")]


def canonical(quads):
    """Blank nodes named by how they are used, so that labels don't matter (enough for these graphs)."""
    names = {}
    quads = list(set(quads))

    def sig(b, depth=3):
        if depth == 0:
            return ""
        t = lambda x: ("_" + sig(x, depth - 1)) if x.k == 0 else x.n3
        return str(sorted([("o", p, t(o), g) for s, p, o, g in quads if s == b] + [("i", p, t(s), g) for s, p, o, g in quads if o == b]))

    for s, _, o, _ in quads:
        for x in (s, o):
            if x.k == 0 and x not in names:
                names[x] = "_:" + sig(x)
    f = lambda x: names.get(x) or x.n3
    return sorted((f(s), p, f(o), g) for s, p, o, g in quads)


@pytest.mark.parametrize("format", ["nt", "nquads", "turtle", "trig", "xml", "json-ld"])
def test_round_trip_of_terms(format):
    quads = edge_cases()
    if format in ("nt", "nquads", "turtle", "trig", "xml"):
        quads += triple_terms()[:1]
    if format == "xml":  # XML has no carriage returns and no control characters
        quads = [q for q in quads if "\r" not in q[2].v and q[2].k != 3] + triple_terms()[:1]
    text = registry.SERIALIZERS[format](quads, R.Namespaces(R.PREFIXES | {"ex": EX}))
    assert canonical(registry.parse(text, format)) == canonical(set(quads))


@pytest.mark.parametrize("format", ["nquads", "trig", "json-ld"])
def test_round_trip_of_graphs(format):
    quads = [(I("a"), EX + "p", literal(1), ""), (I("a"), EX + "p", literal(1), EX + "g1"), (bnode("x"), EX + "p", I("b"), EX + "g2"), (I("b"), EX + "q", literal("z", lang="de"), EX + "g2")]
    text = registry.SERIALIZERS[format](quads, None)
    assert canonical(registry.parse(text, format)) == canonical(quads)


@pytest.mark.parametrize("format", ["turtle", "trig", "json-ld"])
def test_lists_are_written_as_lists(format):
    doc = f'@prefix ex: <{EX}> . ex:s ex:p (1 "two" [ ex:q ex:r ] ()) ; ex:e () .'
    quads = turtle.parse_turtle(doc)
    text = registry.SERIALIZERS[format](quads, R.Namespaces(R.PREFIXES | {"ex": EX}))
    assert "first" not in text and canonical(registry.parse(text, format)) == canonical(quads)


def test_turtle_syntax():
    doc = f"""@prefix : <{EX}> . PREFIX ex: <{EX}> @base <{EX}dir/> .
    <x> a :T ; :n 1, -2.5, 3e4, true ; :m '''multi "q" line
two''' ; :l "h"@en-GB, "r"@ar--rtl ; ; . # note
    [] :p [ :q "v" ] . [ :only 1 ] .
    :a :b :c ~ :r {{| :since 2020 |}} . << :s :p :o ~ :t >> :says true . << :s2 :p :o >> :q <<( :x :y "z" )>> .
    :éé :p <../up>, <#frag>, ex:a\\,b ."""
    got = set(turtle.parse_turtle(doc))
    x = Term(1, EX + "dir/x")
    assert (x, R.TYPE, I("T"), "") in got and (x, EX + "n", literal("-2.5", dt=R.DECIMAL), "") in got and (x, EX + "l", literal("r", lang="ar", dir="rtl"), "") in got
    assert (I("r"), R.REIFIES, triple_term(I("a"), EX + "b", I("c")), "") in got and (I("a"), EX + "b", I("c"), "") in got
    assert (I("t"), R.REIFIES, triple_term(I("s"), EX + "p", I("o")), "") in got and (I("s"), EX + "p", I("o"), "") not in got
    assert (I("éé"), EX + "p", Term(1, EX + "up"), "") in got and (I("éé"), EX + "p", Term(1, EX + "dir/#frag"), "") in got and (I("éé"), EX + "p", I("a,b"), "") in got
    for bad in (":a :b :c .", "<a> <b> .", '"x" <p> <o> .', "<a> <b> <c>", "<a> <b> 'x"):
        with pytest.raises(ValueError):
            turtle.parse_turtle(bad)


def test_trig_syntax():
    doc = f"@prefix : <{EX}> . :d :p 1 . {{ :d :p 2 }} :g {{ :a :b :c . :a :b :d }} GRAPH _:x {{ :a :b [] }} [] {{ :z :z :z }}"
    got = turtle.parse_trig(doc)
    assert {g for *_, g in got} >= {"", EX + "g", "_:x"} and len(got) == 6


def test_rdfxml_syntax():
    doc = f"""<rdf:RDF xmlns:rdf="{R.RDF}" xmlns:ex="{EX}" xml:base="{EX}base" xmlns:its="http://www.w3.org/2005/11/its" rdf:version="1.2">
      <ex:T rdf:about="s" ex:attr="av" xml:lang="fr"><ex:p>plain</ex:p><ex:n rdf:datatype="{R.INTEGER}">5</ex:n><ex:r rdf:resource="#o" rdf:ID="st"/>
        <ex:c rdf:parseType="Collection"><rdf:Description rdf:about="i1"/><ex:U/></ex:c><ex:b rdf:parseType="Resource"><ex:q>v</ex:q></ex:b>
        <ex:x rdf:parseType="Literal">a <b>c</b></ex:x><ex:d its:dir="rtl" xml:lang="ar">w</ex:d><ex:k rdf:annotation="note" rdf:resource="kk"/>
        <ex:t rdf:parseType="Triple"><rdf:Description rdf:about="a"><ex:p rdf:resource="b"/></rdf:Description></ex:t></ex:T>
      <rdf:Seq rdf:about="q"><rdf:li>1</rdf:li><rdf:li>2</rdf:li></rdf:Seq></rdf:RDF>"""
    got = set(rdfxml.parse_rdfxml(doc))
    s = I("s")
    assert (s, EX + "attr", literal("av", lang="fr"), "") in got and (s, EX + "n", literal("5", dt=R.INTEGER), "") in got
    assert (Term(1, EX + "base#st"), R.RDF + "predicate", I("r"), "") in got and (s, EX + "d", literal("w", lang="ar", dir="rtl"), "") in got
    assert (s, EX + "x", Term(2, "a <b>c</b>", R.RDF + "XMLLiteral"), "") in got and (I("q"), R.RDF + "_2", literal("2"), "") in got
    assert (I("note"), R.REIFIES, triple_term(s, EX + "k", I("kk")), "") in got and (s, EX + "t", triple_term(I("a"), EX + "p", I("b")), "") in got
    with pytest.raises(ValueError):
        rdfxml.parse_rdfxml("<not closed")


def test_jsonld_syntax():
    doc = """{"@context": {"ex": "http://example.org/", "name": "ex:name", "knows": {"@id": "ex:knows", "@type": "@id"}, "tags": {"@id": "ex:tags", "@container": "@list"},
      "label": {"@id": "ex:label", "@container": "@language"}, "age": {"@id": "ex:age", "@type": "http://www.w3.org/2001/XMLSchema#int"}, "child": {"@reverse": "ex:parent"}, "@base": "http://example.org/d/"},
      "@id": "a", "@type": "ex:P", "name": ["A", {"@value": "B", "@language": "en"}], "knows": ["b", "_:n"], "tags": [1, 2.5, true], "label": {"de": "x", "fr": ["y", "z"]}, "age": "5",
      "child": {"@id": "ex:kid"}, "@graph": [{"@id": "c", "name": "in"}], "ignored": 3}"""
    got = set(jsonld.parse_jsonld(doc))
    a = I("d/a")
    assert (a, R.TYPE, I("P"), "") in got and (a, EX + "name", literal("B", lang="en"), "") in got and (a, EX + "knows", I("d/b"), "") in got
    assert (a, EX + "age", literal("5", dt=R.XSD + "int"), "") in got and (I("kid"), EX + "parent", a, "") in got and (I("d/c"), EX + "name", literal("in"), EX + "d/a") in got
    assert (a, EX + "label", literal("z", lang="fr"), "") in got and {o.v for _, p, o, _ in got if p == R.FIRST} == {"1", "2.5E0", "true"}


def test_line_reader_modes(spark, tmp_path):
    good = registry.SERIALIZERS["nquads"](edge_cases() + triple_terms() + [(I("a"), EX + "p", I("b"), EX + "g")], None)
    (tmp_path / "x.nq").write_text(good + "\n# note\n   \nbad line .\n<rel> <p> <o> .\n<http://a/x> <http://a/p> \"lit\"@en .# c\n_:a.b <http://a/p> _:c .\n", encoding="utf-8")
    lines = spark.read.text(str(tmp_path / "x.nq"))
    kept = registry.collected(ntriples.parse_lines(lines, "DROPMALFORMED"))
    want = edge_cases() + triple_terms() + [(I("a"), EX + "p", I("b"), EX + "g"), (Term(1, "http://a/x"), "http://a/p", literal("lit", lang="en"), ""), (bnode("a.b"), "http://a/p", bnode("c"), "")]
    assert set(kept) == set(want)
    assert ntriples.parse_lines(lines).where("error is not null").count() == 2
    with pytest.raises(Exception, match="(?i)statement|unexpected|relative"):
        ntriples.parse_lines(lines, "FAILFAST").collect()
    fixed = ntriples.parse_lines(lines, "DROPMALFORMED", repair=lambda line, _: "<http://a/f> <http://a/p> <http://a/o> ." if line.startswith("bad") else None)
    assert fixed.count() == len(kept) + 1
    assert ntriples.parse_lines(lines, "DROPMALFORMED", flatten=True).where("g != ''").count() == 0


def test_native_lines_equal_the_parser(spark):
    lines = [l for l in registry.SERIALIZERS["nquads"](edge_cases(), None).splitlines()]
    df = spark.createDataFrame([(l,) for l in lines], "value string")
    assert set(registry.collected(ntriples.parse_lines(df, "DROPMALFORMED"))) == {ntriples.parse_line(l) for l in lines}
    got = sorted(r.value for r in ntriples.lines_of(ntriples.parse_lines(df, "DROPMALFORMED")).collect())
    assert got == sorted(set(lines))


@pytest.mark.parametrize(("format", "end"), [("nt", "nt"), ("nquads", "nq"), ("turtle", "ttl"), ("trig", "trig"), ("xml", "rdf"), ("json-ld", "jsonld")])
def test_files(spark, tmp_path, format, end):
    quads = [(I("a"), EX + "p", literal("x", lang="en"), ""), (I("a"), EX + "q", I("b"), "")]
    (tmp_path / f"f.{end}").write_text(registry.SERIALIZERS[format](quads, None))
    df = registry.read(spark, str(tmp_path / f"f.{end}"))
    assert set(registry.collected(df)) == set(quads)
    registry.write(df, str(tmp_path / "out"), format)
    back = registry.read(spark, str(tmp_path / "out"), format)
    assert set(registry.collected(back)) == set(quads)


def test_detection():
    assert registry.format_of_name("a/b.ttl.gz") == "turtle" and registry.format_of_media("text/turtle; charset=utf-8") == "turtle"
    assert registry.format_of_content("<a:x> <a:p> <a:o> <a:g> .") == "nquads" and registry.format_of_content('<a:x> <a:p> "o" .') == "nt"
    assert registry.format_of_content("@prefix a: <b> .\na:x a:y a:z .") == "turtle" and registry.format_of_content("PREFIX a: <b>\nGRAPH a:g { a:x a:y a:z }") == "trig"
    assert registry.format_of_content('<?xml version="1.0"?><rdf:RDF/>') == "xml" and registry.format_of_content('{"@id": "x"}') == "json-ld" and registry.format_of_content("hello") is None


def test_results_round_trip(spark):
    rows = [{"a": I("x"), "b": literal("é<&", lang="en")}, {"a": bnode("n")}, {"a": triple_terms()[1][2], "b": literal("1", dt=R.INTEGER)}, {"b": literal("q", lang="ar", dir="rtl")}]
    for write, parse in ((results.to_json, results.from_json), (results.to_xml, results.from_xml)):
        assert parse(write(["a", "b"], rows)) == (["a", "b"], rows)
    assert results.from_json(results.boolean_json(True)) is True and results.from_xml(results.boolean_xml(False)) is False
    df = results.frame_of(spark, ["a", "b"], rows)
    vars, got = results.rows_of(df)
    assert vars == ["a", "b"] and list(got) == rows
    assert results.to_csv(["a", "b"], rows[:2]).splitlines() == ["a,b", f"{EX}x,é<&", "_:n,"] and results.to_tsv(["b"], rows[:1]) == '?b\n"é<&"@en\n'
    assert '"value":"1"' in "".join(r.value for r in results.bindings_lines(df).collect())


def test_terms():
    assert iri("../b", base="http://a/x/y").v == "http://a/b" and R.resolve("http://a/b/c?q", "#f") == "http://a/b/c?q#f" and R.resolve("urn:x:y", "#f") == "urn:x:y#f"
    with pytest.raises(ValueError):
        iri("http://a b")
    assert literal("x", lang="not a tag").lang == "" and literal(3).value() == 3 and literal("abc", dt=R.INTEGER).value() == "abc" and str(literal("1.50", dt=R.DECIMAL).value()) == "1.50"
    assert bnode("x").skolemize("http://h").v == "http://h/.well-known/genid/x" and iri("http://a/b#c").fragment() == "c" and iri("http://a/b#c").defrag().v == "http://a/b"
    assert sorted([literal(10), literal(9), I("a"), bnode("z"), triple_terms()[0][2]])[0].k == 0 and sorted([literal(10), literal(9)])[0].v == "9"
    ns = R.Namespaces({"ex": EX})
    assert ns.qname(EX + "abc") == "ex:abc" and ns.qname("http://other/x#y", generate=True) == "ns1:y" and ns.expand("ex:q") == I("q") and R.Namespace(EX).thing == I("thing")
    with pytest.raises(KeyError):
        R.Namespace(EX, ["a"]).b
