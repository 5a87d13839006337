"""SPARQL updates: each operation makes a new version of the dataset; what it reads is the version before."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import terms as R
from ..dataset import Dataset
from ..engine import instantiate
from ..plans.compiler import Compiler, Rel
from ..plans.parser import SparqlError, Update, parse_update
from ..sources import registry
from ..terms import Term
from .fixpoint import written

KEY = ["g", "s", "p", "o"]


def update(ds: Dataset, text: str, base: str = "", checkpoint: bool = False) -> Dataset:
    """The dataset after all operations of a request, in order. With checkpoint every version is written out, which
    keeps lineage short in long sequences."""
    for op in parse_update(text, base, tuple(sorted(ds.namespaces.by.items()))):
        ds = _apply(ds, op)
        if checkpoint:
            ds = ds.checkpoint()
    return ds


def _quads(ds: Dataset) -> DataFrame:
    return ds.quads if ds.quads is not None else ds.spark.createDataFrame([], R.QUADS)


def _apply(ds: Dataset, op: Update) -> Dataset:
    kind = op.kind
    if kind == "INSERT DATA":
        new = _ground(ds, op.insert)
        graphs = {g.v for g, *_ in op.insert if g is not None}
        return ds.with_quads(_quads(ds).unionByName(new).distinct(), ds.graphs | graphs)
    if kind == "DELETE DATA":
        return ds.with_quads(_quads(ds).join(_ground(ds, op.delete), KEY, "left_anti").select(KEY))
    if kind == "MODIFY":
        return _modify(ds, op)
    if kind in ("CLEAR", "DROP"):
        test = {"DEFAULT": F.col("g") == "", "NAMED": F.col("g") != "", "ALL": F.lit(True)}.get(op.target, F.col("g") == op.target)
        gone = set(ds.graphs) if op.target in ("NAMED", "ALL") else {op.target}
        return ds.with_quads(_quads(ds).where(~test), ds.graphs - gone if kind == "DROP" else ds.graphs)
    if kind == "CREATE":
        return ds.with_quads(ds.quads, ds.graphs | {op.target})
    if kind == "LOAD":
        try:
            return (ds.loader or registry.load)(ds, op.source, op.target or "")
        except Exception:
            if op.silent:
                return ds
            raise
    source, target = ("" if x == "DEFAULT" else x for x in (op.source, op.target))
    if source == target:
        return ds
    q = _quads(ds)
    moved = q.where(F.col("g") == source).withColumn("g", F.lit(target))
    kept = q if kind == "ADD" else q.where(F.col("g") != target)
    if kind == "MOVE":
        kept = kept.where(F.col("g") != source)
    graphs = ds.graphs | ({target} if target else set())
    return ds.with_quads(kept.unionByName(moved).distinct(), graphs - {source} if kind == "MOVE" else graphs)


def _ground(ds: Dataset, quads: list) -> DataFrame:
    unit = Rel(ds.spark.range(1).select(F.lit(1).alias("unit")), {})
    fresh = R.bnode().v  # blank nodes of a request are new ones, the same within an operation
    named = [tuple(_renamed(n, fresh) for n in q) for q in quads]
    out = instantiate(unit, [(g.v if isinstance(g, Term) else g, *t) for g, *t in named])
    return out.distinct()


def _renamed(n, fresh: str):
    if isinstance(n, Term) and n.k == 0:
        return ("fixed", Term(0, fresh + n.v.lstrip(".")))
    if isinstance(n, tuple) and n[0] == "tt":
        return ("tt", *(_renamed(x, fresh) for x in n[1:]))
    return n


def _modify(ds: Dataset, op: Update) -> Dataset:
    view = ds
    if op.using or op.using_named:
        view = ds.restricted(op.using, op.using_named)
    elif op.with_:
        view = _default_as(ds, op.with_)
    where = op.where
    rel = Compiler(view, op.base).compile(where)
    used = {v for q in [*op.delete, *op.insert] for n in q if n is not None for v in _vars(n)}
    keep = [v for v in rel.vars if v in used]
    if keep:
        rel = rel.only(keep)
    rel = replace(rel, df=written(rel.df))  # one snapshot for both templates
    home = op.with_ or ""
    ground = lambda q: [(home if g is None else g.v if isinstance(g, Term) else g, *t) for g, *t in q]
    out = _quads(ds)
    if op.delete:
        out = out.join(instantiate(rel, ground(op.delete)).distinct(), KEY, "left_anti").select(KEY)
    if op.insert:
        out = out.unionByName(instantiate(rel, ground(op.insert))).distinct()
    return ds.with_quads(out)


def _default_as(ds: Dataset, graph: str) -> Dataset:
    """WITH: the named graph stands as the default one; named graphs stay."""
    out = ds.with_quads(ds.quads)
    if ds.quads is not None:
        as_default = ds.quads.where(F.col("g") == graph).withColumn("g", F.lit(""))
        out = ds.with_quads(ds.quads.where("g != ''").unionByName(as_default))
    return out


def _vars(n) -> set[str]:
    if isinstance(n, Term):
        return set()
    return {n[1]} if n[0] == "var" else set().union(*map(_vars, n[1:]))


__all__ = ["SparqlError", "update"]
