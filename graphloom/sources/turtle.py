"""Turtle and TriG, with triple terms, reifiers and annotations: reading and writing."""

from __future__ import annotations

import hashlib
import re

from .. import terms as R
from ..plans.parser import Parser, SparqlError
from ..terms import Namespaces, Term


def fresh_prefix(text: str | bytes) -> str:
    """The start of generated labels; no label of the text starts so."""
    gen = "genid"
    while (gen.encode() if isinstance(text, bytes) else gen) in text:
        gen += "z"
    return gen


class TurtleParser(Parser):
    """Statements share the triple grammar of queries; everything stands for itself, so blank nodes are terms."""

    def __init__(self, text: str, base: str = "", scope: str = ""):
        super().__init__(text, base)
        self.in_template, self.scope, self.gen = True, scope, fresh_prefix(text)
        self.quads: list[tuple[Term, str, Term, str]] = []

    def _blank(self, label: str | None = None) -> Term:
        if label is not None:
            return Term(0, self.scope + label)
        self.fresh += 1
        return Term(0, f"{self.scope}{self.gen}{self.fresh}")

    def parse(self, graphs: bool) -> list[tuple[Term, str, Term, str]]:
        while self.kind != "end":
            if self.kind == "lang" and self.tok in ("@prefix", "@base", "@version"):
                word = self.next()
                if word == "@prefix":
                    name = self.next()
                    if not name.endswith(":"):
                        raise SparqlError(f"bad prefix {name!r}")
                    self.prefixes[name[:-1]] = R.resolve(self.base, self._iriref())
                elif word == "@base":
                    self.base = R.resolve(self.base, self._iriref())
                else:
                    self.next()
                self.need(".")
            elif self.at("PREFIX", "BASE", "VERSION"):
                self.prologue()
            elif graphs and self.at("{"):
                self._block("")
            elif graphs and self.take("GRAPH"):
                g = self._label()
                self._block(g)
            else:
                self._statement(graphs)
        return self.quads

    def _label(self) -> str:
        n = self.node([])
        if not isinstance(n, Term) or n.k not in (0, 1):
            raise SparqlError("a graph name must be an IRI or a blank node")
        return n.v if n.k == 1 else "_:" + n.v

    def _block(self, g: str) -> None:
        self.need("{")
        while not self.at("}"):
            out: list = []
            self._same_subject(out, paths=False)
            self._emit(out, g)
            if not self.take(".") and not self.at("}"):
                raise SparqlError(f"unexpected {self.tok!r}")
        self.need("}")

    def _statement(self, graphs: bool) -> None:
        if graphs and (self.kind in ("iri", "pname", "bnode") and self.t[self.i + 1][1] == "{" or self.at("[") and self.t[self.i + 1][1] == "]" and self.t[self.i + 2][1] == "{"):
            self._block(self._label())
            return
        out: list = []
        self._same_subject(out, paths=False)
        self._emit(out, "")
        self.need(".")

    def _emit(self, triples: list, g: str) -> None:
        def term(n):
            if isinstance(n, Term):
                return n
            if n[0] == "tt":
                return R.triple_term(term(n[1]), term(n[2]).v, term(n[3]))
            raise SparqlError("variables can't stand in data")

        for s, p, o in triples:
            s, p, o = term(s), term(p), term(o)
            if s.k == 2 or p.k != 1:
                raise SparqlError("term of the wrong kind")
            self.quads.append((s, p.v, o, g))


def scope_of(path: str) -> str:
    """Blank nodes of different files stay apart."""
    return "f" + hashlib.md5(path.encode()).hexdigest()[:10] + "x"


def parse_turtle(text: str, base: str = "", scope: str = "") -> list[tuple[Term, str, Term, str]]:
    return TurtleParser(text, base, scope).parse(graphs=False)


def parse_trig(text: str, base: str = "", scope: str = "") -> list[tuple[Term, str, Term, str]]:
    return TurtleParser(text, base, scope).parse(graphs=True)


# writing --------------------------------------------------------------------------------------------------------------


class TurtleWriter:
    """Subjects grouped: classes, then IRIs, then blank nodes; rdf:type and rdfs:label lead; lists and blank nodes that
    are used once stand where they are used."""

    def __init__(self, triples: list[tuple[Term, str, Term]], namespaces: Namespaces | None = None):
        self.ns, self.used = namespaces or Namespaces(R.PREFIXES), set()
        self.by: dict[Term, dict[str, list[Term]]] = {}
        self.uses: dict[Term, int] = {}
        for s, p, o in dict.fromkeys(triples):
            self.by.setdefault(s, {}).setdefault(p, []).append(o)
            for n in self._inside(o):
                self.uses[n] = self.uses.get(n, 0) + 1
            if s.k == 3:
                for n in self._inside(s):
                    self.uses[n] = self.uses.get(n, 0) + 2
        self.done: set[Term] = set()

    def _inside(self, t: Term):
        if t.k == 0:
            yield t
        elif t.k == 3:
            s, _, o = t.parts()
            for x in (s, o):
                for n in self._inside(x):
                    yield n
                    yield n  # inside a triple term it needs its label

    def iri(self, v: str) -> str:
        q = self.ns.qname(v)
        if q is None:
            return f"<{v}>"
        self.used.add(q.partition(":")[0])
        return q

    def term(self, t: Term, depth: int) -> str:
        if t.k == 1:
            return self.iri(t.v)
        if t.k == 3:
            s, p, o = t.parts()
            return f"<<( {self.term(s, 99)} {self.iri(p)} {self.term(o, 99)} )>>"
        if t.k == 0:
            if depth < 40 and self.uses.get(t, 0) == 1 and t not in self.done:
                items = self._list(t)
                if items is not None:
                    return "(" + "".join(" " + self.term(x, depth + 1) for x in items) + " )"
                if t in self.by:
                    self.done.add(t)
                    return "[ " + self._body(t, depth + 1) + " ]"
                if t not in self.by:
                    return "[]"
            return "_:" + t.v
        if t.dt == R.INTEGER and re.fullmatch(r"[+-]?\d+", t.v) or t.dt == R.DECIMAL and re.fullmatch(r"[+-]?\d*\.\d+", t.v) or t.dt == R.DOUBLE and re.fullmatch(r"[+-]?(\d+\.\d*|\.?\d+)[eE][+-]?\d+", t.v) or t.dt == R.BOOLEAN and t.v in ("true", "false"):
            return t.v
        text = t.n3
        return text if t.dt in ("", R.STRING) or t.lang else text[: text.rindex("^^")] + "^^" + self.iri(t.dt)

    def _list(self, head: Term) -> list[Term] | None:
        items, cells = [], []
        while head != Term(1, R.NIL):
            cell = self.by.get(head)
            if cell is None or set(cell) != {R.FIRST, R.REST} or len(cell[R.FIRST]) != 1 or len(cell[R.REST]) != 1 or head in cells or head.k or self.uses.get(head, 0) != 1 or head in self.done:
                return None
            cells.append(head)
            items.append(cell[R.FIRST][0])
            head = cell[R.REST][0]
        self.done.update(cells)
        return items

    def _body(self, s: Term, depth: int) -> str:
        first = {R.TYPE: 0, R.RDFS + "label": 1}
        out = []
        for p in sorted(self.by[s], key=lambda p: (first.get(p, 2), p)):
            verb = "a" if p == R.TYPE else self.iri(p)
            out.append(f"{verb} " + ", ".join(self.term(o, depth) for o in sorted(self.by[s][p])))
        return " ;\n    ".join(out)

    def block(self) -> str:
        def rank(s):
            types = self.by[s].get(R.TYPE, [])
            return (0 if Term(1, R.RDFS + "Class") in types else 1 if s.k == 1 else 2, self.uses.get(s, 0), s)

        out = []
        order = sorted(self.by, key=rank)
        nested = [s for s in order if s.k == 0 and self.uses.get(s, 0) == 1]
        for s in [x for x in order if x not in set(nested)] + nested:
            if s in self.done:
                continue
            self.done.add(s)
            name = "[]" if s.k == 0 and not self.uses.get(s, 0) else "_:" + s.v if s.k == 0 else self.term(s, 99)
            out.append(f"{name} {self._body(s, 0)} .\n")
        return "\n".join(out)

    def header(self) -> str:
        lines = [f"@prefix {p}: <{self.ns.by[p]}> .\n" for p in sorted(self.used)]
        return "".join(lines) + ("\n" if lines else "")


def turtle_text(triples, namespaces: Namespaces | None = None, base: str = "") -> str:
    w = TurtleWriter(list(triples), namespaces)
    body = w.block()
    return (f"@base <{base}> .\n" if base else "") + w.header() + body


def trig_text(quads, namespaces: Namespaces | None = None) -> str:
    """The default graph first, then named graphs in order; empty ones don't show."""
    by: dict[str, list] = {}
    for s, p, o, g in quads:
        by.setdefault(g, []).append((s, p, o))
    parts, used, ns = [], set(), namespaces or Namespaces(R.PREFIXES)
    for g in sorted(by):
        w = TurtleWriter(by[g], ns)
        body = w.block()
        name = "" if not g else (g if g.startswith("_:") else w.iri(g)) + " "
        parts.append(f"{name}{{\n{body}}}\n")
        used |= w.used
    return "".join(f"@prefix {p}: <{ns.by[p]}> .\n" for p in sorted(used)) + "\n" + "\n".join(parts)
