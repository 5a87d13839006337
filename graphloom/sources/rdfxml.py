"""RDF/XML, 1.1 with the 1.2 additions: reading and writing."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from .. import terms as R
from ..plans.parser import SparqlError
from ..terms import Namespaces, Term
from .turtle import fresh_prefix

_RDF, _XML, _ITS = "{" + R.RDF + "}", "{http://www.w3.org/XML/1998/namespace}", "{http://www.w3.org/2005/11/its}"
XML_LITERAL = R.RDF + "XMLLiteral"
_NOT_PROPERTIES = {_RDF + n for n in ("about", "ID", "nodeID", "datatype", "resource", "parseType", "bagID", "li", "aboutEach", "aboutEachPrefix", "annotation", "annotationNodeID", "version")}


def _name(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


class RdfXmlParser:
    def __init__(self, text: str | bytes, base: str = "", scope: str = ""):
        self.base, self.scope, self.fresh = base, scope, 0
        self.out: list[tuple[Term, str, Term, str]] = []
        self.ids: set[str] = set()
        self.gen = fresh_prefix(text)
        try:
            self.root = ET.fromstring(text)
        except ET.ParseError as e:
            raise SparqlError(f"not XML: {e}") from None

    def blank(self, label: str | None = None) -> Term:
        if label is not None:
            return Term(0, self.scope + label)
        self.fresh += 1
        return Term(0, f"{self.scope}{self.gen}{self.fresh}")

    def parse(self) -> list[tuple[Term, str, Term, str]]:
        env = {"base": self.base, "lang": "", "dir": "", "version": ""}
        if self.root.tag == _RDF + "RDF":
            env = self.inherit(self.root, env)
            for e in self.root:
                self.node(e, env)
        else:
            self.node(self.root, env)
        return self.out

    def inherit(self, e, env):
        return {
            "base": R.resolve(env["base"], e.get(_XML + "base")) if e.get(_XML + "base") is not None else env["base"],
            "lang": e.get(_XML + "lang", env["lang"]), "dir": e.get(_ITS + "dir", env["dir"]), "version": e.get(_RDF + "version", env["version"]),
        }

    def add(self, s: Term, p: str, o: Term) -> None:
        self.out.append((s, p, o, ""))

    def text(self, v: str, env) -> Term:
        return R.literal(v, lang=env["lang"], dir=env["dir"])

    def _id(self, value: str, env) -> Term:
        full = R.resolve(env["base"], "#" + value)
        if full in self.ids:
            raise SparqlError(f"rdf:ID {value!r} used twice")
        self.ids.add(full)
        return Term(1, full)

    def node(self, e, env) -> Term:
        env = self.inherit(e, env)
        if e.get(_RDF + "about") is not None:
            s = Term(1, R.resolve(env["base"], e.get(_RDF + "about")))
        elif e.get(_RDF + "ID") is not None:
            s = self._id(e.get(_RDF + "ID"), env)
        else:
            s = self.blank(e.get(_RDF + "nodeID"))
        if e.tag != _RDF + "Description":
            self.add(s, R.TYPE, Term(1, _name(e.tag)))
        for k, v in e.attrib.items():
            if k in _NOT_PROPERTIES or k.startswith((_XML, _ITS)) or not k.startswith("{"):
                continue
            self.add(s, _name(k), Term(1, R.resolve(env["base"], v)) if k == _RDF + "type" else self.text(v, env))
        count = 0
        for c in e:
            if c.tag == _RDF + "li":
                count += 1
            self.property(s, f"{R.RDF}_{count}" if c.tag == _RDF + "li" else _name(c.tag), c, env)
        return s

    def property(self, s: Term, p: str, e, env) -> None:
        env = self.inherit(e, env)
        kind = e.get(_RDF + "parseType")
        extra = [(k, v) for k, v in e.attrib.items() if k.startswith("{") and k not in _NOT_PROPERTIES and not k.startswith((_XML, _ITS))]
        if kind == "Resource":
            o = self.blank()
            count = 0
            for c in e:
                count += c.tag == _RDF + "li"
                self.property(o, f"{R.RDF}_{count}" if c.tag == _RDF + "li" else _name(c.tag), c, env)
        elif kind == "Collection":
            items = [self.node(c, env) for c in e]
            cells = [self.blank() for _ in items]
            for i, (cell, x) in enumerate(zip(cells, items, strict=True)):
                self.add(cell, R.FIRST, x)
                self.add(cell, R.REST, cells[i + 1] if i + 1 < len(cells) else Term(1, R.NIL))
            o = cells[0] if cells else Term(1, R.NIL)
        elif kind == "Triple":
            if env["version"] != "1.2":
                return
            mark = len(self.out)
            for c in e:
                self.node(c, env)
            inner, self.out[mark:] = self.out[mark:], []
            if len(inner) != 1:
                raise SparqlError('parseType="Triple" needs one triple')
            o = R.triple_term(inner[0][0], inner[0][1], inner[0][2])
        elif kind is not None:
            body = escape(e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in e)
            o = Term(2, body, XML_LITERAL)
        elif e.get(_RDF + "resource") is not None or e.get(_RDF + "nodeID") is not None or extra and not len(e) and not (e.text or "").strip():
            if e.get(_RDF + "resource") is not None:
                o = Term(1, R.resolve(env["base"], e.get(_RDF + "resource")))
            else:
                o = self.blank(e.get(_RDF + "nodeID"))
            for k, v in extra:
                self.add(o, _name(k), Term(1, R.resolve(env["base"], v)) if k == _RDF + "type" else self.text(v, env))
        elif len(e):
            if len(e) > 1:
                raise SparqlError("a property element holds one node")
            o = self.node(e[0], env)
        else:
            dt = e.get(_RDF + "datatype")
            o = Term(2, e.text or "", R.resolve(env["base"], dt)) if dt is not None else self.text(e.text or "", env)
        self.add(s, p, o)
        if e.get(_RDF + "ID") is not None:
            r = self._id(e.get(_RDF + "ID"), env)
            self.add(r, R.TYPE, Term(1, R.RDF + "Statement"))
            self.add(r, R.RDF + "subject", s)
            self.add(r, R.RDF + "predicate", Term(1, p))
            self.add(r, R.RDF + "object", o)
        note = e.get(_RDF + "annotation")
        if note is not None or e.get(_RDF + "annotationNodeID") is not None:
            r = Term(1, R.resolve(env["base"], note)) if note is not None else self.blank(e.get(_RDF + "annotationNodeID"))
            self.add(r, R.REIFIES, R.triple_term(s, p, o))


def parse_rdfxml(text: str | bytes, base: str = "", scope: str = "") -> list[tuple[Term, str, Term, str]]:
    return RdfXmlParser(text, base, scope).parse()


def rdfxml_text(triples, namespaces: Namespaces | None = None, base: str = "") -> str:
    ns = namespaces or Namespaces(R.PREFIXES)
    by: dict[Term, list] = {}
    for s, p, o in dict.fromkeys(triples):
        by.setdefault(s, []).append((p, o))
    used = {"rdf": R.RDF}

    def qname(v: str) -> str:
        q = ns.qname(v, generate=True)
        if q is None or not re.fullmatch(r"[A-Za-z_][\w.-]*:[A-Za-z_][\w.-]*", q):
            raise ValueError(f"no XML name for {v}")
        prefix = q.partition(":")[0]
        used[prefix] = ns.by[prefix]
        return q

    body = []
    for s in sorted(by):
        if s.k == 3:
            raise ValueError("a triple term can't be a subject here")
        tag, rest = "rdf:Description", sorted(by[s])
        for p, o in rest:
            if p == R.TYPE and o.k == 1:
                try:
                    tag = qname(o.v)
                except ValueError:
                    continue
                rest = [x for x in rest if x != (p, o)]
                break
        who = f"rdf:about={quoteattr(s.v)}" if s.k == 1 else f"rdf:nodeID={quoteattr(s.v)}"
        lines = [f"  <{tag} {who}>"]
        for p, o in rest:
            lines.append("    " + _property_text(qname(p), o, qname))
        body.append("\n".join([*lines, f"  </{tag}>"]))
    space = "".join(f"\n    xmlns:{p}={quoteattr(u)}" for p, u in sorted(used.items()))
    version = '\n    rdf:version="1.2"' if any(o.k == 3 for v in by.values() for _, o in v) else ""
    its = '\n    xmlns:its="http://www.w3.org/2005/11/its"' if any(o.dir for v in by.values() for _, o in v) else ""
    where = f"\n    xml:base={quoteattr(base)}" if base else ""
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF{space}{its}{version}{where}>\n' + "\n".join(body) + "\n</rdf:RDF>\n"


def _property_text(tag: str, o: Term, qname) -> str:
    if o.k == 1:
        return f"<{tag} rdf:resource={quoteattr(o.v)}/>"
    if o.k == 0:
        return f"<{tag} rdf:nodeID={quoteattr(o.v)}/>"
    if o.k == 3:
        s, p, x = o.parts()
        who = f"rdf:about={quoteattr(s.v)}" if s.k == 1 else f"rdf:nodeID={quoteattr(s.v)}"
        return f'<{tag} rdf:parseType="Triple"><rdf:Description {who}>{_property_text(qname(p), x, qname)}</rdf:Description></{tag}>'
    if o.lang:
        way = f" its:dir={quoteattr(o.dir)}" if o.dir else ""
        return f"<{tag} xml:lang={quoteattr(o.lang)}{way}>{escape(o.v)}</{tag}>"
    if o.dt == XML_LITERAL:
        return f'<{tag} rdf:parseType="Literal">{o.v}</{tag}>'
    dt = "" if o.dt in ("", R.STRING) else f" rdf:datatype={quoteattr(o.dt)}"
    return f"<{tag}{dt}>{escape(o.v)}</{tag}>"
