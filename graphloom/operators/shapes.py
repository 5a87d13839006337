"""The shapes graph on the driver: lists, paths, prefixes, targets and per-constraint overrides."""

from __future__ import annotations

from .. import terms as R
from ..terms import SH, Term

IRI = lambda v: Term(1, v)
SHNEX = "http://www.w3.org/ns/shacl-node-expr#"


class ShapesGraph:
    def __init__(self, triples):
        self.by: dict[Term, dict[str, list[Term]]] = {}
        self.overrides: dict[str, dict[str, list[Term]]] = {}
        for s, p, o in triples:
            self.by.setdefault(s, {}).setdefault(p, []).append(o)
        for s, ps in self.by.items():
            for o in ps.get(R.REIFIES, []):
                if o.k == 3:
                    self.overrides[o.v] = ps

    def all(self, s: Term, name: str) -> list[Term]:
        return self.by.get(s, {}).get(name if ":" in name else SH + name, [])

    def one(self, s: Term, name: str) -> Term | None:
        return next(iter(self.all(s, name)), None)

    def items(self, head: Term) -> list[Term]:
        out, seen = [], set()
        while head != IRI(R.NIL) and head not in seen and self.all(head, R.FIRST):
            seen.add(head)
            out.append(self.all(head, R.FIRST)[0])
            head = self.one(head, R.REST) or IRI(R.NIL)
        return out

    def is_list(self, t: Term) -> bool:
        return t == IRI(R.NIL) or bool(self.all(t, R.FIRST))

    def listed(self, t: Term) -> list[Term]:
        """The members of a list, or the term alone."""
        return self.items(t) if self.is_list(t) else [t]

    def override(self, s: Term, p: str, o: Term, name: str) -> Term | None:
        return next(iter(self.overrides.get(R.triple_term(s, p, o).v, {}).get(SH + name, [])), None)

    def path(self, t: Term) -> tuple:
        """A property path of the query algebra."""
        if t.k == 1:
            return ("link", t.v)
        if self.is_list(t):
            parts = [self.path(x) for x in self.items(t)]
            out = parts[0]
            for p in parts[1:]:
                out = ("seq", out, p)
            return out
        for name, kind in (("inversePath", "inv"), ("zeroOrMorePath", "star"), ("oneOrMorePath", "plus"), ("zeroOrOnePath", "opt")):
            if x := self.one(t, name):
                return (kind, self.path(x))
        if x := self.one(t, "alternativePath"):
            parts = [self.path(y) for y in self.items(x)]
            out = parts[0]
            for p in parts[1:]:
                out = ("alt", out, p)
            return out
        raise ValueError(f"not a path: {t.n3}")

    def shapes(self) -> list[Term]:
        """Everything that is a shape with targets of its own or by its class."""
        out = []
        for s, ps in self.by.items():
            types = {t.v for t in ps.get(R.TYPE, [])}
            has = {p[len(SH) :] for p in ps if p.startswith(SH)}
            if types & {SH + "NodeShape", SH + "PropertyShape", SH + "ShapeClass"} or has & {"targetNode", "targetClass", "targetSubjectsOf", "targetObjectsOf", "targetWhere", "target"}:
                out.append(s)
        return sorted(out)

    def implicit_class(self, s: Term) -> bool:
        types = {t.v for t in self.all(s, R.TYPE)}
        return s.k == 1 and (R.RDFS + "Class" in types or R.OWL + "Class" in types or SH + "ShapeClass" in types)

    def prologue(self, node: Term) -> str:
        """PREFIX lines of sh:prefixes, following owl:imports."""
        out, todo, seen = [], list(self.all(node, "prefixes")), set()
        while todo:
            t = todo.pop()
            if t in seen:
                continue
            seen.add(t)
            todo += self.all(t, R.OWL + "imports")
            for d in self.all(t, "declare"):
                prefix, space = self.one(d, "prefix"), self.one(d, "namespace")
                if prefix and space:
                    out.append(f"PREFIX {prefix.v}: <{space.v}>")
        return "\n".join(out) + "\n"

    def components(self) -> list[Term]:
        return sorted(s for s, ps in self.by.items() if IRI(SH + "ConstraintComponent") in ps.get(R.TYPE, []))


def path_text(p: tuple) -> str:
    """A path in query syntax."""
    kind = p[0]
    if kind == "link":
        return f"<{p[1]}>"
    if kind in ("seq", "alt"):
        return f"({path_text(p[1])}{'/' if kind == 'seq' else '|'}{path_text(p[2])})"
    if kind == "inv":
        return f"(^{path_text(p[1])})"
    return f"({path_text(p[1])}){ {'star': '*', 'plus': '+', 'opt': '?'}[kind] }"
