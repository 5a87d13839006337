"""Typed column values: native lanes where the datatype is known when a query is planned, term structs elsewhere.

Kinds: bool, int, dec, flt, dbl, str, iri, dt (timestamp without zone), date, term. A null column is an error or an
unbound variable.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import terms as R
from ..terms import Term

DATATYPES = {"bool": R.BOOLEAN, "int": R.INTEGER, "dec": R.DECIMAL, "flt": R.FLOAT, "dbl": R.DOUBLE, "str": R.STRING, "dt": R.DATETIME, "date": R.DATE}
NUMBERS = ("int", "dec", "flt", "dbl")


@dataclass(frozen=True)
class Rep:
    """How a variable's column holds its terms: a kind and, for IRIs, the text before the key."""

    kind: str
    prefix: str = ""
    key: str = "str"  # the key's type: str or int


TERM_REP = Rep("term")


@dataclass
class Val:
    kind: str
    col: Column
    const: Term | None = None
    rep: Rep | None = None  # of an IRI that is still a key column
    key: Column | None = None


def null_val() -> Val:
    return Val("term", F.lit(None).cast(R.TERM))


def constant(t: Term) -> Val:
    if t.k == 1:
        return Val("iri", F.lit(t.v), t)
    if t.k == 2:
        v = t.value()
        if t.dt == R.STRING:
            return Val("str", F.lit(t.v), t)
        if t.dt == R.BOOLEAN and isinstance(v, bool):
            return Val("bool", F.lit(v), t)
        if t.dt == R.INTEGER and isinstance(v, int) and abs(v) < 2**63:
            return Val("int", F.lit(v).cast("bigint"), t)
        if t.dt == R.DECIMAL and not isinstance(v, str):
            return Val("dec", F.lit(v), t)
        if t.dt == R.DOUBLE and isinstance(v, float):
            return Val("dbl", F.lit(v), t)
    return Val("term", R.const(t), t)


def of_rep(rep: Rep, col: Column) -> Val:
    if rep.kind == "iri":
        text = col.cast("string") if not rep.prefix else F.concat(F.lit(rep.prefix), col.cast("string"))
        return Val("iri", text, None, rep, col)
    if rep.kind == "row":
        return Val("term", as_term_rep(rep, col))
    return Val(rep.kind, col)


def as_term_rep(rep: Rep, col: Column) -> Column:
    if rep.kind == "row":
        return R.make(0, F.when(col.isNotNull(), F.concat(F.lit("r"), F.md5(F.to_json(col)))))
    return as_term(of_rep(rep, col))


def lexical(v: Val) -> Column:
    """The lexical form of a native value."""
    c = v.col
    if v.kind in ("str", "iri"):
        return c
    if v.kind == "dec":
        return decimal_text(c)
    if v.kind in ("dbl", "flt"):
        return double_text(c)
    if v.kind == "dt":
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(c, "SSSSSS")
        return F.when(micros == "000000", text).otherwise(F.concat(text, F.lit("."), F.regexp_replace(micros, "0+$", "")))
    return c.cast("string")


def decimal_text(c: Column) -> Column:
    s = F.when(c.isNotNull(), c.cast("decimal(38,10)").cast("string"))
    return F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def double_text(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s == "Infinity", "INF").when(s == "-Infinity", "-INF").otherwise(s)


def as_term(v: Val) -> Column:
    if v.kind == "term":
        return v.col
    if v.const is not None:
        return R.const(v.const)
    if v.kind == "iri":
        return R.make(1, v.col)
    return R.make(2, lexical(v), DATATYPES[v.kind])


def text_of(v: Val) -> Column:
    """STR(): an IRI's text or a literal's lexical form."""
    return F.when(v.col["k"].isin(1, 2), v.col["v"]) if v.kind == "term" else lexical(v)


def string_of(v: Val) -> Column:
    """The text of a string literal (with or without a language), else null."""
    if v.kind == "str":
        return v.col
    if v.kind == "term":
        return F.when((v.col["k"] == 2) & v.col["dt"].isin(R.STRING, R.LANG_STRING, R.DIR_LANG_STRING), v.col["v"])
    return F.lit(None).cast("string")


_INT, _DEC, _DBL = r"^[+-]?\d+$", r"^[+-]?(\d+(\.\d*)?|\.\d+)$", r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def number(v: Val) -> tuple[Column, Column, Column]:
    """(rank, decimal, double): rank 1 integer, 2 decimal, 3 float, 4 double, null if not a number."""
    if v.kind in NUMBERS:
        rank = F.lit(NUMBERS.index(v.kind) + 1)
        dec = v.col.cast("decimal(38,10)") if v.kind in ("int", "dec") else F.lit(None).cast("decimal(38,10)")
        return F.when(v.col.isNotNull(), rank), dec, v.col.cast("double")
    if v.kind != "term":
        none = F.lit(None)
        return none.cast("int"), none.cast("decimal(38,10)"), none.cast("double")
    c = v.col
    special = c["v"].isin("INF", "+INF", "-INF", "NaN")
    rank = (
        F.when(c["k"] != 2, None)
        .when(c["dt"].isin(*R.INTEGER_BOUNDS) & c["v"].rlike(_INT), 1)
        .when((c["dt"] == R.DECIMAL) & c["v"].rlike(_DEC), 2)
        .when((c["dt"] == R.FLOAT) & (c["v"].rlike(_DBL) | special), 3)
        .when((c["dt"] == R.DOUBLE) & (c["v"].rlike(_DBL) | special), 4)
    )
    dec = F.when(rank <= 2, c["v"].try_cast("decimal(38,10)"))
    word = F.regexp_replace(F.regexp_replace(c["v"], r"^\+", ""), "INF", "Infinity")
    return rank, dec, F.when(rank.isNotNull(), word.try_cast("double"))


def numeric_term(rank: Column, dec: Column, dbl: Column) -> Column:
    text = F.when(rank == 1, dec.cast("decimal(38,0)").cast("string")).when(rank == 2, decimal_text(dec)).otherwise(double_text(dbl))
    dt = F.when(rank == 1, R.INTEGER).when(rank == 2, R.DECIMAL).when(rank == 3, R.FLOAT).otherwise(R.DOUBLE)
    return R.make(2, F.when(rank.isNotNull(), text), dt)


_ZONE = r"(Z|[+-]\d\d:\d\d)?$"


def instant(v: Val) -> Column:
    """Seconds since the epoch (decimal) of a dateTime, date or time; without an offset as UTC."""
    if v.kind == "dt":
        return F.unix_micros(v.col.cast("timestamp")).cast("decimal(38,6)") / 1_000_000
    if v.kind == "date":
        return (F.unix_date(v.col) * 86400).cast("decimal(38,6)")
    if v.kind != "term":
        return F.lit(None).cast("decimal(38,6)")
    c = v.col
    zone = F.regexp_extract(c["v"], _ZONE, 1)
    shift = F.when(zone.isin("", "Z"), 0).otherwise(
        (F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, 5, 2).try_cast("int") * 60) * F.when(zone.startswith("-"), -1).otherwise(1)
    )
    local = F.regexp_replace(c["v"], _ZONE, "")
    local = F.when(c["dt"] == R.TIME, F.concat(F.lit("1970-01-01T"), local)).when(c["dt"] == R.DATE, F.concat(local, F.lit("T00:00:00"))).when(c["dt"] == R.DATETIME, local)
    at = F.when(local.rlike(r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?$"), local.try_cast("timestamp_ntz"))
    return F.when(c["k"] == 2, F.unix_micros(at.cast("timestamp")).cast("decimal(38,6)") / 1_000_000 - shift)


def is_kind(v: Val, k: int) -> Column:
    if v.kind == "term":
        return v.col["k"] == k
    return F.when(v.col.isNotNull(), F.lit(k == (1 if v.kind == "iri" else 2)))


def boolean(v: Val) -> Column:
    """Effective boolean value; null is an error."""
    if v.kind == "bool":
        return v.col
    if v.kind in NUMBERS:
        return (v.col != 0) & ~F.isnan(v.col.cast("double"))
    if v.kind == "str":
        return F.length(v.col) > 0
    if v.kind == "term":
        c = v.col
        _, _, dbl = number(v)
        return (
            F.when(c["k"] != 2, None)
            .when(c["dt"].isin(R.STRING, R.LANG_STRING, R.DIR_LANG_STRING), F.length(c["v"]) > 0)
            .when(c["dt"] == R.BOOLEAN, c["v"].isin("true", "1"))
            .when(c["dt"].isin(*R.NUMERIC), F.coalesce((dbl != 0) & ~F.isnan(dbl), F.lit(False)))
        )
    return F.lit(None).cast("boolean")


def _family(kind: str) -> str:
    return "num" if kind in NUMBERS else kind


def equal(a: Val, b: Val) -> Column:
    """Value equality: null where two literals can't be compared."""
    if a.kind != "term" and b.kind != "term":
        fa, fb = _family(a.kind), _family(b.kind)
        if fa == fb == "num":
            x, y = _aligned(a, b)
            return (x == y) & ~F.isnan(x.cast("double")) if "dbl" in (a.kind, b.kind) else x == y
        if fa == fb == "iri":
            return _same_iri(a, b)
        if fa == fb:
            return a.col == b.col
        never = F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
        return never if "iri" in (fa, fb) else F.lit(None).cast("boolean")
    x, y = as_term(a), as_term(b)
    ra, da, na = number(a)
    rb, db, nb = number(b)
    ia, ib = instant(a), instant(b)
    text = [R.STRING, R.LANG_STRING, R.DIR_LANG_STRING]
    return (
        F.when(x.isNull() | y.isNull(), None)
        .when((ra <= 2) & (rb <= 2), da == db)
        .when(ra.isNotNull() & rb.isNotNull(), (na == nb) & ~F.isnan(na))
        .when(x == y, True)
        .when((x["k"] != y["k"]) | (x["k"] != 2), False)
        .when(x["dt"].isin(*text) & y["dt"].isin(*text), False)
        .when((x["dt"] == R.BOOLEAN) & (y["dt"] == R.BOOLEAN), x["v"].isin("true", "1") == y["v"].isin("true", "1"))
        .when((x["dt"] == y["dt"]) & ia.isNotNull() & ib.isNotNull(), ia == ib)
    )


def _same_iri(a: Val, b: Val) -> Column:
    """Native comparison of key columns where both texts come from templates."""
    if a.rep and b.rep and a.rep == b.rep:
        return a.key == b.key
    for x, y in ((a, b), (b, a)):
        if x.rep and y.const is not None:
            return key_equals(x.rep, x.key, y.const)
    return a.col == b.col


def key_equals(rep: Rep, key: Column, t: Term) -> Column:
    """A template's key column against a constant: the constant is turned into a key, so that it reaches the scan."""
    rest = t.v[len(rep.prefix) :]
    if t.k != 1 or not t.v.startswith(rep.prefix) or rep.key == "int" and not (rest.lstrip("-").isdigit() and str(int(rest)) == rest):
        return F.when(key.isNotNull(), F.lit(False))
    return key == (F.lit(int(rest)) if rep.key == "int" else F.lit(rest))


def _aligned(a: Val, b: Val) -> tuple[Column, Column]:
    if {a.kind, b.kind} <= {"int", "dec"}:
        return a.col, b.col
    return a.col.cast("double"), b.col.cast("double")


def less(a: Val, b: Val, or_equal: bool) -> Column:
    op = (lambda x, y: x <= y) if or_equal else (lambda x, y: x < y)
    if a.kind != "term" and b.kind != "term":
        fa, fb = _family(a.kind), _family(b.kind)
        if fa == fb == "num":
            x, y = _aligned(a, b)
            out = op(x, y)
            return out & ~F.isnan(y) & ~F.isnan(x) if {a.kind, b.kind} & {"flt", "dbl"} else out
        return op(a.col, b.col) if fa == fb and fa != "iri" else F.lit(None).cast("boolean")
    x, y = as_term(a), as_term(b)
    ra, da, na = number(a)
    rb, db, nb = number(b)
    ia, ib = instant(a), instant(b)
    return (
        F.when((ra <= 2) & (rb <= 2), op(da, db))
        .when(ra.isNotNull() & rb.isNotNull(), op(na, nb) & ~F.isnan(na) & ~F.isnan(nb))
        .when((x["k"] == 2) & (y["k"] == 2) & (x["dt"] == y["dt"]) & (x["lang"] == y["lang"]) & x["dt"].isin(R.STRING, R.LANG_STRING), op(x["v"], y["v"]))
        .when((x["dt"] == R.BOOLEAN) & (y["dt"] == R.BOOLEAN), op(x["v"].isin("true", "1").cast("int"), y["v"].isin("true", "1").cast("int")))
        .when((x["dt"] == y["dt"]) & ia.isNotNull() & ib.isNotNull(), op(ia, ib))
    )


def arithmetic(op: str, a: Val, b: Val) -> Val:
    """+ - * /: whole numbers stay whole but for /, decimals stay decimal, the rest are doubles; / 0 is an error."""
    fs = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}
    if a.kind in NUMBERS and b.kind in NUMBERS:
        if {a.kind, b.kind} <= {"int", "dec"}:
            if a.kind == b.kind == "int" and op != "/":
                return Val("int", fs[op](a.col, b.col))
            wide = lambda v: v.col.cast("decimal(20,0)") if v.kind == "int" else v.col
            return Val("dec", fs[op](wide(a), wide(b)))
        out = fs[op](a.col.cast("double"), b.col.cast("double"))
        return Val("flt" if "dbl" not in (a.kind, b.kind) else "dbl", out)
    ra, da, na = number(a)
    rb, db, nb = number(b)
    rank = F.when(ra.isNotNull() & rb.isNotNull(), F.greatest(ra, rb))
    if op == "/":
        rank = F.when(rank == 1, 2).otherwise(rank)
    dec = fs[op](da, db).cast("decimal(38,10)") if op != "*" else F.try_multiply(da.cast("decimal(28,10)"), db.cast("decimal(28,10)")).cast("decimal(38,10)")
    dbl = fs[op](na, nb)
    ok = F.when(rank <= 2, dec.isNotNull()).otherwise(dbl.isNotNull())
    return Val("term", numeric_term(F.when(ok, rank), dec, dbl))


def sort_columns(v: Val) -> list[Column]:
    """Columns whose order is the term order: unbound, blank nodes, IRIs, literals by value, triple terms."""
    if v.kind != "term":
        return [v.col]
    c = v.col
    rank, _, dbl = number(v)
    at = instant(v)
    family = F.when(rank.isNotNull(), 0).when(at.isNotNull(), 1).otherwise(2)
    return [c["k"], F.when(c["k"] == 2, family), F.when(c["k"] == 2, F.coalesce(dbl, at.cast("double"))), c["v"], c["dt"], c["lang"]]
