"""Node expressions: ordered node lists for each focus node, as (focus, i, value) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import terms as R
from ..functions.values import Val, number, numeric_term, sort_columns
from ..terms import SH, Term
from .shapes import IRI, SHNEX


def evaluate_expression(v, e: Term, focus: DataFrame, scope: dict | None = None) -> DataFrame:
    """Rows (focus, i, value) of an expression; focus nodes without a result have no row. v is a Validator."""
    sg = v.shapes
    focus = focus.select("focus").distinct()
    props = {p[len(SHNEX) :]: os for p, os in sg.by.get(e, {}).items() if p.startswith(SHNEX)}
    if e.k != 0:
        if e == IRI(SH + "this"):
            return focus.select("focus", F.lit(0).alias("i"), F.col("focus").alias("value"))
        return _empty(v) if e == IRI(R.NIL) else focus.select("focus", F.lit(0).alias("i"), R.const(e).alias("value"))
    if sg.is_list(e):
        return _concat(v, [evaluate_expression(v, x, focus, scope) for x in sg.items(e)])
    run = lambda x, f=None: evaluate_expression(v, x, focus if f is None else f, scope)
    first = lambda name: props[name][0]
    nodes = lambda: run(first("nodes")) if "nodes" in props else _nodes_arg(v, props, run)
    if "var" in props:
        name = first("var").v
        if name in ("focusNode", "this"):
            return focus.select("focus", F.lit(0).alias("i"), F.col("focus").alias("value"))
        return _empty(v) if not scope or name not in scope else focus.select("focus", F.lit(0).alias("i"), R.const(scope[name]).alias("value"))
    if "pathValues" in props:
        path = sg.path(first("pathValues"))
        if "focusNode" in props:
            starts = run(first("focusNode"))
            got = v.along(path, starts.select(F.col("value").alias("focus"))).withColumnsRenamed({"focus": "start", "value": "end"})
            return _numbered(starts.withColumnRenamed("value", "start").join(got, "start").select("focus", F.col("end").alias("value")).distinct())
        return _numbered(v.along(path, focus))
    if "concat" in props:
        return _concat(v, [run(x) for x in sg.listed(first("concat"))])
    if "distinct" in props:
        return _first_places(run(first("distinct")))
    if "count" in props:
        n = focus.join(run(first("count")).groupBy("focus").agg(F.count("*").alias("n")), "focus", "left")
        return n.select("focus", F.lit(0).alias("i"), R.make(2, F.coalesce("n", F.lit(0)).cast("string"), R.INTEGER).alias("value"))
    if "sum" in props:
        return _sum(_mapped(v, run(first("sum")), props, scope), focus)
    for name, pick in (("min", F.min), ("max", F.max)):
        if name in props:
            rank, dec, dbl = number(Val("term", F.col("value")))
            got = run(first(name)).withColumn("n", dbl).where("n is not null")
            return got.groupBy("focus").agg(pick(F.struct("n", (F.col("i") * (-1 if name == "max" else 1)).alias("j"), "value")).alias("b")).select("focus", F.lit(0).alias("i"), "b.value")
    if "exists" in props:
        some = run(first("exists")).select("focus").distinct().withColumn("there", F.lit(True))
        return _truth(focus.join(some, "focus", "left").withColumn("ok", F.coalesce("there", F.lit(False))))
    if "filterShape" in props or "findFirst" in props or "matchAll" in props:
        name = next(n for n in ("filterShape", "findFirst", "matchAll") if n in props)
        rows = nodes()
        bad = v.failing(first(name), rows.select(F.col("value").alias("focus"))).select(F.col("focus").alias("value"))
        good = rows.join(bad, "value", "left_anti").select("focus", "i", "value")
        if name == "filterShape":
            return _renumbered(good)
        if name == "findFirst":
            return good.groupBy("focus").agg(F.min(F.struct("i", "value")).alias("b")).select("focus", F.lit(0).alias("i"), "b.value")
        some_bad = rows.join(bad, "value", "left_semi").select("focus").distinct().withColumn("bad", F.lit(True))
        return _truth(focus.join(some_bad, "focus", "left").withColumn("ok", F.col("bad").isNull()))
    if "nodesMatching" in props:
        every = v.triples.select(F.col("s").alias("focus")).union(v.triples.select(F.col("o").alias("focus"))).distinct()
        good = every.join(v.failing(first("nodesMatching"), every), "focus", "left_anti").select(F.col("focus").alias("value"))
        return _numbered(focus.crossJoin(good))
    if "instancesOf" in props:
        kind = run(first("instancesOf")).select("focus", F.col("value").alias("c"))
        return _numbered(kind.join(v.types, "c").select("focus", F.col("n").alias("value")).distinct())
    if "intersection" in props:
        parts = [run(x) for x in sg.listed(first("intersection"))]
        out = _first_places(parts[0])
        for p in parts[1:]:
            out = out.join(p.select("focus", "value").distinct(), ["focus", "value"], "left_semi").select("focus", "i", "value")
        return _renumbered(out)
    if "remove" in props:
        gone = run(first("remove")).select("focus", "value").distinct()
        return _renumbered(nodes().join(gone, ["focus", "value"], "left_anti").select("focus", "i", "value"))
    if "if" in props:
        got = run(first("if")).where(F.col("value") == R.const(Term(2, "true", R.BOOLEAN))).select("focus").distinct()
        yes, no = focus.join(got, "focus", "left_semi"), focus.join(got, "focus", "left_anti")
        parts = [run(first(n), f) for n, f in (("then", yes), ("else", no)) if n in props]
        return _concat(v, parts)
    if "limit" in props:
        return _renumbered(nodes()).where(F.col("i") < int(first("limit").v))
    if "offset" in props:
        return _renumbered(_renumbered(nodes()).where(F.col("i") >= int(first("offset").v)))
    if "orderBy" in props:
        rows = nodes()
        keys = evaluate_expression(v, first("orderBy"), rows.select(F.col("value").alias("focus")), scope).where("i = 0").select(F.col("focus").alias("value"), F.col("value").alias("key"))
        down = "desc" in props and first("desc").v in ("true", "1")
        cols = sort_columns(Val("term", F.col("key")))
        w = Window.partitionBy("focus").orderBy(*[c.desc_nulls_last() if down else c.asc_nulls_first() for c in cols], "i")
        return rows.join(keys, "value", "left").select("focus", (F.row_number().over(w) - 1).alias("i"), "value")
    if "flatMap" in props:
        return _mapped(v, nodes(), props, scope)
    return _empty(v)  # a blank node without an expression is the empty list


def _nodes_arg(v, props, run) -> DataFrame:
    for name in ("input", "of", "in"):
        if name in props:
            return run(props[name][0])
    raise ValueError("a node expression without nodes")


def _empty(v) -> DataFrame:
    return v.spark.createDataFrame([], f"focus {R.TERM_DDL}, i int, value {R.TERM_DDL}")


def _concat(v, parts: list[DataFrame]) -> DataFrame:
    out = None
    for k, p in enumerate(parts):
        p = p.select("focus", F.struct(F.lit(k).alias("k"), F.col("i").cast("int").alias("i")).alias("at"), "value")
        out = p if out is None else out.union(p)
    if out is None:
        return _empty(v)
    w = Window.partitionBy("focus").orderBy("at")
    return out.select("focus", (F.row_number().over(w) - 1).alias("i"), "value")


def _numbered(rows: DataFrame) -> DataFrame:
    """An order for sets: by term."""
    return rows.select("focus", (F.row_number().over(Window.partitionBy("focus").orderBy("value")) - 1).alias("i"), "value")


def _renumbered(rows: DataFrame) -> DataFrame:
    return rows.select("focus", (F.row_number().over(Window.partitionBy("focus").orderBy("i")) - 1).alias("i"), "value")


def _first_places(rows: DataFrame) -> DataFrame:
    return _renumbered(rows.groupBy("focus", "value").agg(F.min("i").alias("i")).select("focus", "i", "value"))


def _truth(rows: DataFrame) -> DataFrame:
    return rows.select("focus", F.lit(0).alias("i"), R.make(2, F.col("ok").cast("string"), R.BOOLEAN).alias("value"))


def _sum(rows: DataFrame, focus: DataFrame) -> DataFrame:
    rank, dec, dbl = number(Val("term", F.col("value")))
    got = rows.select("focus", rank.alias("rank"), dec.alias("d"), dbl.alias("x")).groupBy("focus").agg(F.max("rank").alias("rank"), F.sum("d").cast("decimal(38,10)").alias("d"), F.sum("x").alias("x"))
    out = focus.join(got, "focus", "left")
    term = numeric_term(F.coalesce("rank", F.lit(1)), F.coalesce("d", F.lit(0)), F.coalesce("x", F.lit(0.0)))
    return out.select("focus", F.lit(0).alias("i"), term.alias("value"))


def _mapped(v, rows: DataFrame, props, scope) -> DataFrame:
    """flatMap: an expression evaluated for each node, the results in order."""
    if "flatMap" not in props:
        return rows
    got = evaluate_expression(v, props["flatMap"][0], rows.select(F.col("value").alias("focus")), scope).select(F.col("focus").alias("at"), F.col("i").alias("j"), F.col("value").alias("out"))
    joined = rows.join(got, rows["value"] == got["at"]).select("focus", F.struct("i", "j").alias("at"), F.col("out").alias("value"))
    w = Window.partitionBy("focus").orderBy("at")
    return joined.select("focus", (F.row_number().over(w) - 1).alias("i"), "value")
