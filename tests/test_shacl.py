"""One data graph and many shapes; each constraint names the focus nodes that must violate it."""

import pytest

from graphloom import terms as R
from graphloom.dataset import Dataset
from graphloom.operators import shacl
from graphloom.operators.shapes import SHNEX
from graphloom.sources import turtle

pytestmark = pytest.mark.usefixtures("interpreted")

EX = "http://example.org/"
HEAD = f"@prefix : <{EX}> . @prefix sh: <{R.SH}> . @prefix rdfs: <{R.RDFS}> . @prefix rdf: <{R.RDF}> . @prefix xsd: <{R.XSD}> . @prefix owl: <{R.OWL}> . @prefix shnex: <{SHNEX}> .\n"
DATA = """
:a a :P ; :name "Ann", "Anna"@en, "Anne"@en ; :age 30 ; :kid :b ; :mail "ann@x.org" ; :start 1 ; :end 5 ; :l (1 2 2) ; :code "x\\ny" .
:b a :S ; :name "Bob" ; :age "abc"^^xsd:integer ; :kid "none" ; :start 5 ; :end 5 ; :extra 1 ; :l (1 2) ; :same :c ; :same2 :c .
:c a :P ; :age 200, 5 ; :kid :a, _:x ; :start 9 ; :end 5, 10 ; :l () ; :same :a ; :same2 :b ; :d "2020-01-01"^^xsd:date ; :by "7"^^xsd:byte, "300"^^xsd:byte .
:S rdfs:subClassOf :P . _:x :age 1 .
<< :a :kid :b ~ :r1 >> :sure 0.9 . << :c :kid :a ~ :r2 >> :sure 2 .
"""


@pytest.fixture(scope="module")
def data(spark):
    return Dataset.of(spark, turtle.parse_turtle(HEAD + DATA))


def run(data, shapes):
    sg = shacl.ShapesGraph([q[:3] for q in turtle.parse_turtle(HEAD + shapes)])
    rows = shacl.validate(data, sg).collect()
    cut = lambda t: None if t is None else t.v.removeprefix(EX) if t.k else "_"
    return sorted({(cut(r.focus), cut(r.value), r.component.removeprefix(R.SH).removesuffix("ConstraintComponent").removeprefix(EX)) for r in rows}, key=repr)


T = ":Sh a sh:NodeShape ; sh:targetClass :P ; "
PS = ":Sh a sh:PropertyShape ; sh:targetClass :P ; "
CASES = [
    (PS + "sh:path :name ; sh:minCount 1 .", [("c", None, "MinCount")]),
    (PS + "sh:path :age ; sh:maxCount 1 .", [("c", None, "MaxCount")]),
    (PS + "sh:path :kid ; sh:class :P .", [("b", "none", "Class"), ("c", "_", "Class")]),
    (PS + "sh:path :age ; sh:datatype xsd:integer .", [("b", "abc", "Datatype")]),
    (PS + "sh:path :by ; sh:datatype xsd:byte .", [("c", "300", "Datatype")]),
    (PS + "sh:path :kid ; sh:nodeKind sh:IRI .", [("b", "none", "NodeKind"), ("c", "_", "NodeKind")]),
    (PS + "sh:path :age ; sh:minInclusive 18 ; sh:maxExclusive 200 .", [("b", "abc", "MaxExclusive"), ("b", "abc", "MinInclusive"), ("c", "200", "MaxExclusive"), ("c", "5", "MinInclusive")]),
    (PS + "sh:path :start ; sh:minExclusive 1 ; sh:maxInclusive 5 .", [("a", "1", "MinExclusive"), ("c", "9", "MaxInclusive")]),
    (PS + "sh:path :name ; sh:minLength 4 ; sh:maxLength 4 .", [("a", "Ann", "MinLength"), ("b", "Bob", "MinLength")]),
    (PS + 'sh:path :name ; sh:pattern "^an" ; sh:flags "i" .', [("b", "Bob", "Pattern")]),
    (PS + 'sh:path :name ; sh:languageIn ("en" "de") .', [("a", "Ann", "LanguageIn"), ("b", "Bob", "LanguageIn")]),
    (PS + "sh:path :name ; sh:uniqueLang true .", [("a", None, "UniqueLang")]),
    (PS + "sh:path :code ; sh:singleLine true .", [("a", "x\ny", "SingleLine")]),
    (PS + "sh:path :same ; sh:equals :same2 .", [("c", "a", "Equals"), ("c", "b", "Equals")]),
    (PS + "sh:path :same ; sh:disjoint :same2 .", [("b", "c", "Disjoint")]),
    (PS + "sh:path :start ; sh:lessThan :end .", [("b", "5", "LessThan"), ("c", "9", "LessThan")]),
    (PS + "sh:path :start ; sh:lessThanOrEquals :end .", [("c", "9", "LessThanOrEquals")]),
    (PS + "sh:path :same ; sh:subsetOf [ sh:alternativePath (:same2 :kid) ] .", []),
    (PS + "sh:path :same ; sh:subsetOf :same2 .", [("c", "a", "SubsetOf")]),
    (T + "sh:and ([ sh:path :name ; sh:minCount 1 ] [ sh:path :mail ; sh:minCount 1 ]) .", [("b", "b", "And"), ("c", "c", "And")]),
    (T + "sh:or ([ sh:path :name ; sh:minCount 1 ] [ sh:path :mail ; sh:minCount 1 ]) .", [("c", "c", "Or")]),
    (T + "sh:not [ sh:path :mail ; sh:minCount 1 ] .", [("a", "a", "Not")]),
    (T + "sh:xone ([ sh:path :name ; sh:minCount 1 ] [ sh:path :mail ; sh:minCount 1 ]) .", [("a", "a", "Xone"), ("c", "c", "Xone")]),
    (PS + "sh:path :kid ; sh:node :N . :N sh:property [ sh:path :name ; sh:minCount 1 ] .", [("b", "none", "Node"), ("c", "_", "Node")]),
    (T + "sh:property [ sh:path :kid ; sh:property [ sh:path :age ; sh:minCount 1 ] ] .", [("none", None, "MinCount")]),
    (PS + "sh:path :kid ; sh:qualifiedValueShape [ sh:nodeKind sh:IRI ] ; sh:qualifiedMinCount 1 ; sh:qualifiedMaxCount 1 .", [("b", None, "QualifiedMinCount")]),
    (PS + "sh:path :kid ; sh:someValue [ sh:class :S ] .", [("b", None, "SomeValue"), ("c", None, "SomeValue")]),
    (PS + "sh:path :kid ; sh:hasValue :b .", [("b", None, "HasValue"), ("c", None, "HasValue")]),
    (PS + 'sh:path :name ; sh:in ("Bob" "Ann") .', [("a", "Anna", "In"), ("a", "Anne", "In")]),
    (":Sh a sh:NodeShape ; sh:targetNode :b ; sh:closed true ; sh:ignoredProperties (rdf:type :l :same :same2) ; sh:property [ sh:path :name ] , [ sh:path :age ] , [ sh:path :kid ] , [ sh:path :start ], [ sh:path :end ] .", [("b", "1", "Closed")]),
    (":P a rdfs:Class, sh:NodeShape ; sh:property [ sh:path :name ], [ sh:path :age ], [ sh:path :kid ], [ sh:path :start ], [ sh:path :end ], [ sh:path :l ] . :Sh a sh:NodeShape ; sh:targetNode :b ; sh:closed sh:ByTypes ; sh:ignoredProperties (:same :same2) .", [("b", "1", "Closed")]),
    (PS + "sh:path :l ; sh:uniqueMembers true .", [("a", "_", "UniqueMembers")]),
    (PS + "sh:path :l ; sh:minListLength 1 ; sh:maxListLength 2 .", [("a", "_", "MaxListLength"), ("c", R.NIL, "MinListLength")]),
    (PS + "sh:path :l ; sh:memberShape [ sh:maxExclusive 2 ] .", [("a", "_", "MemberShape"), ("b", "_", "MemberShape")]),
    (PS + "sh:path :kid ; sh:reifierShape [ sh:property [ sh:path :sure ; sh:maxInclusive 1 ] ] .", [("c", "a", "ReifierShape")]),
    (PS + "sh:path :kid ; sh:reificationRequired true .", [("b", "none", "ReifierShape"), ("c", "_", "ReifierShape")]),
    (PS + "sh:path :start ; sh:datatype (xsd:string xsd:decimal) .", [("a", "1", "Datatype"), ("b", "5", "Datatype"), ("c", "9", "Datatype")]),
    (PS + "sh:path :kid ; sh:nodeKind (sh:IRI sh:Literal) .", [("c", "_", "NodeKind")]),
    (PS + "sh:path :kid ; sh:class (:P :Q) .", [("b", "none", "Class"), ("c", "_", "Class")]),
    (PS + "sh:path (:kid :kid) ; sh:maxCount 0 .", [("a", None, "MaxCount"), ("c", None, "MaxCount")]),
    (PS + "sh:path [ sh:inversePath :kid ] ; sh:minCount 1 .", [("c", None, "MinCount")]),
    (PS + "sh:path [ sh:oneOrMorePath :kid ] ; sh:hasValue :b .", [("b", None, "HasValue")]),
    (":Sh a sh:NodeShape ; sh:targetSubjectsOf :extra ; sh:hasValue :zz .", [("b", None, "HasValue")]),
    (":Sh a sh:NodeShape ; sh:targetObjectsOf :same ; sh:nodeKind sh:Literal .", [("a", "a", "NodeKind"), ("c", "c", "NodeKind")]),
    (":Sh a sh:NodeShape ; sh:targetWhere [ sh:path :mail ; sh:minCount 1 ] ; sh:nodeKind sh:Literal .", [("a", "a", "NodeKind")]),
    (f':Sh a sh:NodeShape ; sh:target [ sh:select "SELECT ?this WHERE {{ ?this <{EX}extra> ?x }}" ] ; sh:nodeKind sh:Literal .', [("b", "b", "NodeKind")]),
    (f':Sh a sh:NodeShape ; sh:targetClass :P ; sh:sparql [ sh:message "{{$this}} is bad" ; sh:select "SELECT $this ?value WHERE {{ $this <{EX}age> ?value FILTER(?value > 100) }}" ] .', [("c", "200", "SPARQL")]),
    (f':Sh a sh:PropertyShape ; sh:targetClass :P ; sh:path :start ; sh:sparql [ sh:select "SELECT $this ?value WHERE {{ $this $PATH ?value . FILTER NOT EXISTS {{ $this <{EX}end> ?e FILTER(?e > ?value) }} }}" ] .', [("b", "5", "SPARQL")]),
    (':Sh a sh:NodeShape ; sh:targetNode :a ; sh:sparql [ sh:select "SELECT $this WHERE { broken" ] .', [("a", None, "SPARQL")]),
    (f':C a sh:ConstraintComponent ; sh:parameter [ sh:path :least ] ; sh:validator [ sh:ask "ASK {{ FILTER(isNUMERIC($value) && $value >= $least) }}" ; sh:message "below {{$least}}" ] . :Sh a sh:PropertyShape ; sh:targetClass :P ; sh:path :age ; :least 10 .', [("b", "abc", "C"), ("c", "5", "C")]),
    (f':C a sh:ConstraintComponent ; sh:parameter [ sh:path :need ] ; sh:nodeValidator [ sh:select "SELECT $this WHERE {{ FILTER NOT EXISTS {{ $this $need ?x }} }}" ] . :Sh a sh:NodeShape ; sh:targetClass :P ; :need :mail .', [("b", "b", "C"), ("c", "c", "C")]),
    (PS + "sh:path :name ; sh:minCount 1 ; sh:deactivated true .", []),
    (PS + "sh:path :name ; sh:minCount 1 {| sh:deactivated true |} .", []),
    (T + "sh:expression [ shnex:exists [ shnex:pathValues :mail ] ] .", [("b", "b", "Expression"), ("c", "c", "Expression")]),
    (":Sh a sh:PropertyShape ; sh:targetNode :a ; sh:path :v ; sh:values [ shnex:concat ([ shnex:pathValues :age ] ( 7 )) ] ; sh:maxInclusive 10 .", [("a", "30", "MaxInclusive")]),
]


@pytest.mark.parametrize(("shapes", "want"), CASES, ids=range(len(CASES)))
def test_constraint(data, shapes, want):
    assert run(data, shapes) == sorted(want, key=repr)


def test_report(spark, data):
    sg = shacl.ShapesGraph([q[:3] for q in turtle.parse_turtle(HEAD + PS + 'sh:path :name ; sh:minCount 1 {| sh:severity sh:Debug |} ; sh:message "no name" ; sh:severity sh:Warning ; sh:maxCount 2 .')])
    rows = {r.component.removeprefix(R.SH): r for r in shacl.validate(data, sg).collect()}
    assert rows["MinCountConstraintComponent"].severity == R.SH + "Debug" and rows["MaxCountConstraintComponent"].severity == R.SH + "Warning"
    assert rows["MaxCountConstraintComponent"].messages == ["no name"] and rows["MaxCountConstraintComponent"].path.v == EX + "name"
    report = shacl.validate(data, sg)
    assert not shacl.conforms(report) and shacl.conforms(report.where(f"severity = '{R.SH}Debug'"))
    assert shacl.conforms(shacl.validate(data, shacl.ShapesGraph([])))
    with pytest.raises(ValueError, match="recursive"):
        shacl.validate(data, shacl.ShapesGraph([q[:3] for q in turtle.parse_turtle(HEAD + ":Sh a sh:NodeShape ; sh:targetClass :P ; sh:node :Sh .")]))


EXPRESSIONS = [
    ("( 1 2 1 )", ["1", "2", "1"]), ("[ shnex:distinct ( 1 2 1 ) ]", ["1", "2"]), ("[ shnex:var \"focusNode\" ]", ["c"]), ("[ shnex:count [ shnex:pathValues :age ] ]", ["2"]), ("[ shnex:sum [ shnex:pathValues :age ] ]", ["205"]),
    ("[ shnex:min [ shnex:pathValues :age ] ]", ["5"]), ("[ shnex:max [ shnex:pathValues :age ] ]", ["200"]), ("[ shnex:exists [ shnex:pathValues :zz ] ]", ["false"]), ("[ shnex:nodes ( 1 20 3 ) ; shnex:filterShape [ sh:maxExclusive 10 ] ]", ["1", "3"]),
    ("[ shnex:nodes ( 30 20 3 ) ; shnex:findFirst [ sh:maxExclusive 25 ] ]", ["20"]), ("[ shnex:nodes ( 1 2 ) ; shnex:matchAll [ sh:maxExclusive 2 ] ]", ["false"]), ("[ shnex:nodesMatching [ sh:path :extra ; sh:minCount 1 ] ]", ["b"]),
    ("[ shnex:instancesOf :S ]", ["b"]), ("[ shnex:intersection ( ( 3 1 2 ) ( 2 3 ) ) ]", ["3", "2"]), ("[ shnex:nodes ( 1 2 3 ) ; shnex:remove ( 2 ) ]", ["1", "3"]), ("[ shnex:if true ; shnex:then 5 ; shnex:else 6 ]", ["5"]),
    ("[ shnex:if [ shnex:exists () ] ; shnex:then 5 ; shnex:else 6 ]", ["6"]), ("[ shnex:nodes ( 1 2 3 ) ; shnex:limit 2 ]", ["1", "2"]), ("[ shnex:nodes ( 1 2 3 ) ; shnex:offset 2 ]", ["3"]),
    ("[ shnex:nodes ( :a :b ) ; shnex:orderBy [ shnex:pathValues :start ] ; shnex:desc true ]", ["b", "a"]), ("[ shnex:nodes ( :b :a ) ; shnex:flatMap [ shnex:pathValues :start ] ]", ["5", "1"]),
    ("[ shnex:pathValues :start ; shnex:focusNode :a ]", ["1"]), ("[ shnex:concat ( ( 1 ) ( 2 1 ) ) ]", ["1", "2", "1"]), ("[]", []), ("()", []), (":x", ["x"]),
]


@pytest.mark.parametrize(("text", "want"), EXPRESSIONS)
def test_node_expression(data, text, want):
    quads = turtle.parse_turtle(HEAD + f":holder :e {text} .")
    v = shacl.Validator(data, shacl.ShapesGraph([q[:3] for q in quads]))
    e = next(o for s, p, o, _ in quads if p == EX + "e")
    rows = v.expression(e, v.terms([R.Term(1, EX + "c")], "focus")).orderBy("i").collect()
    assert [r.value.v.removeprefix(EX) for r in rows] == want
