"""Property paths from Python: link(p) / link(q), ~p, p | q, p.star(), p.plus(), p.opt(), negated(p, ~q)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..dataset import Dataset
from ..terms import Term
from .compiler import Compiler, col


class Path:
    def __init__(self, tree: tuple):
        self.tree = tree

    def __truediv__(self, other: "Path") -> "Path":
        return Path(("seq", self.tree, as_path(other).tree))

    def __or__(self, other: "Path") -> "Path":
        return Path(("alt", self.tree, as_path(other).tree))

    def __invert__(self) -> "Path":
        return Path(("inv", self.tree))

    def star(self) -> "Path":
        return Path(("star", self.tree))

    def plus(self) -> "Path":
        return Path(("plus", self.tree))

    def opt(self) -> "Path":
        return Path(("opt", self.tree))


def link(predicate: str | Term) -> Path:
    return Path(("link", predicate.v if isinstance(predicate, Term) else predicate))


def as_path(x) -> Path:
    return x if isinstance(x, Path) else link(x)


def negated(*parts) -> Path:
    trees = [as_path(p).tree for p in parts]
    if any(t[0] not in ("link", "inv") or t[0] == "inv" and t[1][0] != "link" for t in trees):
        raise ValueError("a negated set holds predicates and inverse ones")
    return Path(("neg", tuple(t[1] for t in trees if t[0] == "link"), tuple(t[1][1] for t in trees if t[0] == "inv")))


def pairs(ds: Dataset, path: Path, s: Term | None = None, o: Term | None = None, graph: str = "") -> DataFrame:
    """(s, o) along a path, from or to given terms."""
    c = Compiler(ds)
    c.graph = graph
    a, b = s or ("var", "s"), o or ("var", "o")
    rel = c.compile_path(a, path.tree, b)
    from .. import terms as R

    cell = lambda n, name: R.const(n) if isinstance(n, Term) else col(name)
    for v in list(rel.vars):
        rel = rel.lifted(v)
    return rel.df.select(cell(a, "s").alias("s"), cell(b, "o").alias("o"))
