import pytest

from graphloom import terms as R
from graphloom.dataset import Dataset
from graphloom.operators import rules
from graphloom.plans.parser import SparqlError
from graphloom.sources import turtle

pytestmark = pytest.mark.usefixtures("interpreted")

EX = "http://example.org/"
P = f"PREFIX : <{EX}> "


def run(spark, text, data):
    ds = Dataset.of(spark, turtle.parse_turtle(f"@prefix : <{EX}> . " + data))
    cut = lambda t: t.v.removeprefix(EX) if t.k else "_"
    return sorted((cut(r.s), r.p.removeprefix(EX), cut(r.o)) for r in rules.evaluate(rules.parse_rules(P + text), ds).collect())


def test_recursion_negation_and_data(spark):
    got = run(
        spark,
        """DATA { :d :parent :e }
           RULE { ?x :anc ?y } WHERE { ?x :parent ?y }
           RULE { ?x :anc ?z } WHERE { ?x :anc ?y . ?y :anc ?z }
           RULE { ?x :leaf true } WHERE { ?z :parent ?x . NOT { ?x :parent ?y } }
           RULE { ?x :big ?n } WHERE { ?x :size ?s FILTER(?s > 5) BIND(?s * 2 AS ?n) }
           RULE { ?x :top true } WHERE { ?x :anc ?y . NOT { ?z :anc ?x } }""",
        ":a :parent :b . :b :parent :c . :c :parent :d . :a :size 3 . :b :size 9 .",
    )
    pairs = [(x, "anc", y) for i, x in enumerate("abcde") for y in "abcde"[i + 1 :]]
    assert got == sorted(pairs + [("e", "leaf", "true"), ("b", "big", "18"), ("a", "top", "true"), ("d", "parent", "e")])


def test_new_nodes_and_triple_terms(spark):
    got = run(spark, "RULE { _:n :of ?x ; :in ?y } WHERE { ?x :p ?y } RULE { ?x :says <<( ?x :p ?y )>> } WHERE { ?x :p ?y }", ":a :p :b . :c :p :b .")
    assert len(got) == 6 and len({s for s, p, _ in got if p == "says"}) == 2
    assert run(spark, "RULE { ?x :q ?y } WHERE { << ?x :p ?y >> :sure true }", "<< :a :p :b >> :sure true .") == [("a", "q", "b")]


def test_cycles_stop(spark):
    assert len(run(spark, "RULE { ?x :r ?z } WHERE { ?x :r ?y . ?y :r ?z }", ":a :r :b . :b :r :c . :c :r :a .")) == 6


@pytest.mark.parametrize("bad", ["RULE { ?x :p ?y } WHERE { ?x :q ?z }", "RULE { ?x :p ?y } WHERE { ?x :q ?y BIND(1 AS ?y) }", "RULE { ?x :p 1 } WHERE { ?x :q ?y FILTER(?z > 1) }", "RULE { ?x :p 1 } WHERE { ?x :q 1 NOT { ?x :p 1 } }",
                                 "RULE { ?x :p 1 } WHERE { ?x :a 1 NOT { ?x :r 1 } } RULE { ?x :r 1 } WHERE { ?x :p 1 }", "DATA { ?x :p 1 }", "RULE { ?x :p 1 }"])
def test_malformed(spark, bad):
    with pytest.raises(SparqlError):
        run(spark, bad, ":a :q 1 .")


def test_strata():
    rs = rules.parse_rules(P + "RULE { ?x :c 1 } WHERE { ?x :a 1 NOT { ?x :b 1 } } RULE { ?x :b 1 } WHERE { ?x :a 2 } RULE { ?x :d 1 } WHERE { ?x :c 1 }")
    assert rules.stratify(rs) == [[1], [0, 2]]
    assert rs.rules[0].head[0][1] == R.Term(1, EX + "c")
