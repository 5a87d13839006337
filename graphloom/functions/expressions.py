"""SPARQL expressions as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import terms as R
from ..terms import Term
from .values import NUMBERS, Val, arithmetic, as_term, boolean, constant, decimal_text, double_text, equal, instant, is_kind, less, lexical, null_val, number, numeric_term, string_of, text_of

FUNCTIONS: dict[str, Callable] = {}
#: Functions by IRI: f(scope, *values) gives a Val; see register().
CUSTOM: dict[str, Callable] = {}


def register(iri: str, f: Callable) -> None:
    """Let queries call <iri>(...); f(scope, *values) builds a column, so it stays in the plan."""
    CUSTOM[iri] = f


class Scope:
    """What an expression sees: variables, the request's base and time, and how EXISTS is compiled."""

    def __init__(self, vars: dict[str, Val], base: str = "", exists=None, now: str = ""):
        self.vars, self.base, self.exists, self.now = vars, base, exists, now


def function(*names):
    def put(f):
        for n in names:
            FUNCTIONS[n] = f
        return f

    return put


def evaluate(e: tuple, scope: Scope) -> Val:
    kind = e[0]
    if kind == "var":
        return scope.vars.get(e[1]) or null_val()
    if kind == "term":
        return constant(e[1])
    if kind == "val":
        return e[1]
    if kind == "op":
        return _operator(e[1], e[2], e[3], scope)
    if kind == "not":
        return Val("bool", ~boolean(evaluate(e[1], scope)))
    if kind == "neg":
        v = evaluate(e[1], scope)
        if v.kind in NUMBERS:
            return Val(v.kind, -v.col)
        rank, dec, dbl = number(v)
        return Val("term", numeric_term(rank, -dec, -dbl))
    if kind == "in":
        v = evaluate(e[1], scope)
        if not e[2]:
            return Val("bool", F.lit(e[3]))
        items = [evaluate(x, scope) for x in e[2]]
        if v.kind in ("int", "str", "dec") and all(x.kind == v.kind and x.const for x in items):
            out = v.col.isin(*[x.const.value() for x in items])
        else:
            out = equal(v, items[0])
            for x in items[1:]:
                out = out | equal(v, x)
        return Val("bool", ~out if e[3] else out)
    if kind == "exists":
        return Val("bool", scope.exists(e))
    if kind == "cast" and e[1] in CUSTOM:
        return CUSTOM[e[1]](scope, *[evaluate(x, scope) for x in e[2]])
    if kind == "cast":
        return _cast(e[1], [evaluate(x, scope) for x in e[2]])
    if kind == "agg":
        raise ValueError("an aggregate outside grouping")
    name, args = e[1], e[2]
    if name == "BOUND":
        v = scope.vars.get(args[0][1])
        return Val("bool", v.col.isNotNull() if v else F.lit(False))
    if name == "IF":
        c, a, b = (evaluate(x, scope) for x in args)
        test, kind, x, y = boolean(c), *_common(a, b)
        return Val(kind, F.when(test.isNull(), None).when(test, x).otherwise(y))
    if name == "COALESCE":
        if not args:
            return null_val()
        out = evaluate(args[0], scope)
        for x in args[1:]:
            kind, p, q = _common(out, evaluate(x, scope))
            out = Val(kind, F.coalesce(p, q))
        return out
    return FUNCTIONS[name](scope, *[evaluate(x, scope) for x in args])


def _common(a: Val, b: Val) -> tuple[str, Column, Column]:
    return (a.kind, a.col, b.col) if a.kind == b.kind else ("term", as_term(a), as_term(b))


def _operator(op: str, x: tuple, y: tuple, scope: Scope) -> Val:
    a, b = evaluate(x, scope), evaluate(y, scope)
    if op == "&&":
        return Val("bool", boolean(a) & boolean(b))
    if op == "||":
        return Val("bool", boolean(a) | boolean(b))
    if op in ("+", "-", "*", "/"):
        return arithmetic(op, a, b)
    a, b = _dated(a, b), _dated(b, a)
    if op == "=":
        return Val("bool", equal(a, b))
    if op == "!=":
        return Val("bool", ~equal(a, b))
    if op in ("<", "<="):
        return Val("bool", less(a, b, op == "<="))
    return Val("bool", less(b, a, op == ">="))


def _dated(a: Val, b: Val) -> Val:
    """A constant date beside a native one becomes native, so that it reaches the scan."""
    if a.const is not None and a.kind == "term" and b.kind in ("dt", "date"):
        if a.const.dt == R.DATETIME and b.kind == "dt" and (a.const.v.endswith("Z") or "T" in a.const.v and a.const.v[-6] not in "+-"):
            return Val("dt", F.lit(a.const.v.removesuffix("Z")).cast("timestamp_ntz"))
        if a.const.dt == R.DATE and b.kind == "date":
            return Val("date", F.lit(a.const.v).cast("date"))
    return a


def _like(source: Val, text: Column) -> Val:
    """A string with the language, direction and datatype of source."""
    if source.kind == "str":
        return Val("str", text)
    c = source.col
    return Val("term", R.make(2, text, c["dt"], c["lang"], c["dir"]))


@function("ISIRI", "ISURI")
def _(s, a):
    return Val("bool", is_kind(a, 1))


@function("ISBLANK")
def _(s, a):
    return Val("bool", is_kind(a, 0))


@function("ISLITERAL")
def _(s, a):
    return Val("bool", is_kind(a, 2))


@function("ISTRIPLE")
def _(s, a):
    return Val("bool", is_kind(a, 3))


@function("ISNUMERIC")
def _(s, a):
    if a.kind != "term":
        return Val("bool", F.when(a.col.isNotNull(), F.lit(a.kind in NUMBERS)))
    return Val("bool", F.when(a.col.isNotNull(), number(a)[0].isNotNull()))


@function("STR")
def _(s, a):
    return Val("str", text_of(a))


@function("STRLEN")
def _(s, a):
    return Val("int", F.length(string_of(a)).cast("bigint"))


@function("SUBSTR")
def _(s, a, start, n=None):
    text, _, first = string_of(a), *number(start)[1:]
    first = F.greatest(F.round(first).cast("int"), F.lit(1))
    if n is None:
        return _like(a, F.substr(text, first))
    return _like(a, F.substr(text, first, F.greatest(F.round(number(n)[2]).cast("int"), F.lit(0))))


@function("UCASE")
def _(s, a):
    return _like(a, F.upper(string_of(a)))


@function("LCASE")
def _(s, a):
    return _like(a, F.lower(string_of(a)))


def _agree(a: Val, b: Val) -> Column:
    """Argument compatibility: the second has no language or that of the first."""
    if b.kind == "str":
        return F.lit(True)
    y = as_term(b)
    return (y["lang"] == "") | ((as_term(a)["lang"] == y["lang"]) & (as_term(a)["dir"] == y["dir"]))


def _string_test(test):
    return lambda s, a, b: Val("bool", F.when(_agree(a, b), test(string_of(a), string_of(b))))


FUNCTIONS["STRSTARTS"] = _string_test(lambda a, b: F.startswith(a, b))
FUNCTIONS["STRENDS"] = _string_test(lambda a, b: F.endswith(a, b))
FUNCTIONS["CONTAINS"] = _string_test(lambda a, b: F.contains(a, b))


@function("STRBEFORE")
def _(s, a, b):
    x, y = string_of(a), string_of(b)
    at = F.position(y, x)
    found, hit = F.when(_agree(a, b), at > 0), F.substr(x, F.lit(1), F.greatest(at - 1, F.lit(0)))
    return _found(a, found, hit)


@function("STRAFTER")
def _(s, a, b):
    x, y = string_of(a), string_of(b)
    at = F.position(y, x)
    return _found(a, F.when(_agree(a, b), at > 0), F.substr(x, at + F.length(y)))


def _found(a: Val, found: Column, hit: Column) -> Val:
    if a.kind == "str":
        return Val("str", F.when(found, hit).when(~found, ""))
    return Val("term", F.when(found, as_term(_like(a, hit))).when(~found, R.const(Term(2, "", R.STRING))))


@function("CONCAT")
def _(s, *args):
    if not args:
        return constant(Term(2, "", R.STRING))
    text = F.concat(*[string_of(a) for a in args])
    if all(a.kind == "str" for a in args):
        return Val("str", text)
    first = as_term(args[0])
    same = F.lit(True)
    for a in args[1:]:
        t = as_term(a)
        same = same & (t["lang"] == first["lang"]) & (t["dir"] == first["dir"])
    return Val("term", F.when(same, R.make(2, text, first["dt"], first["lang"], first["dir"])).otherwise(R.make(2, text, R.STRING)))


def _pattern(p: Val, flags: Val | None) -> Column:
    """The pattern with its flags inline: i, s, m, x and q (plain text)."""
    text = string_of(p)
    if flags is None:
        return text
    if flags.const is not None:
        f = flags.const.v
        if "q" in f:
            text = F.concat(F.lit("\\Q"), text, F.lit("\\E"))
        keep = "".join(c for c in f if c in "ismx")
        return F.concat(F.lit(f"(?{keep})"), text) if keep else text
    f = F.regexp_replace(string_of(flags), "[^ismx]", "")
    return F.when(f == "", text).otherwise(F.concat(F.lit("(?"), f, F.lit(")"), text))


@function("REGEX")
def _(s, a, p, flags=None):
    pat = _pattern(p, flags)
    if p.const is not None and _bad_pattern(p.const.v, flags):
        return Val("bool", F.lit(False))
    return Val("bool", F.rlike(string_of(a), pat))


def _bad_pattern(p: str, flags) -> bool:
    import re

    if flags is not None and flags.const is not None and "q" in flags.const.v:
        return False
    try:
        re.compile(re.sub(r"\\[pP]\{[^}]*\}", ".", p))
    except re.error as e:
        return "nothing to repeat" in str(e) or "unterminated" in str(e) or "missing" in str(e) or "unbalanced" in str(e)
    return False


@function("REPLACE")
def _(s, a, p, to, flags=None):
    if p.const is not None and _bad_pattern(p.const.v, flags):
        return _like(a, string_of(a))
    return _like(a, F.regexp_replace(string_of(a), _pattern(p, flags), string_of(to)))


@function("LANG")
def _(s, a):
    return Val("str", F.when(a.col["k"] == 2, a.col["lang"])) if a.kind == "term" else Val("str", F.when(a.col.isNotNull() & F.lit(a.kind != "iri"), ""))


@function("LANGDIR")
def _(s, a):
    return Val("str", F.when(a.col["k"] == 2, a.col["dir"])) if a.kind == "term" else Val("str", F.when(a.col.isNotNull() & F.lit(a.kind != "iri"), ""))


@function("HASLANG")
def _(s, a):
    t = as_term(a)
    return Val("bool", (t["k"] == 2) & (t["lang"] != ""))


@function("HASLANGDIR")
def _(s, a):
    t = as_term(a)
    return Val("bool", (t["k"] == 2) & (t["dir"] != ""))


@function("DATATYPE")
def _(s, a):
    t = as_term(a)
    return Val("iri", F.when(t["k"] == 2, F.when(t["dt"] == "", R.STRING).otherwise(t["dt"])))


def _rounding(native, name):
    def f(s, a):
        if a.kind == "int":
            return Val("int", F.abs(a.col)) if name == "abs" else a
        if a.kind in ("dec", "flt", "dbl"):
            out = native(a.col)
            return Val(a.kind, out.cast("decimal(38,10)") if a.kind == "dec" and name != "abs" else out.cast("double") if a.kind != "dec" else out)
        rank, dec, dbl = number(a)
        return Val("term", numeric_term(rank, native(dec).cast("decimal(38,10)"), native(dbl).cast("double")))

    return f


FUNCTIONS["ABS"] = _rounding(F.abs, "abs")
FUNCTIONS["ROUND"] = _rounding(lambda c: F.round(c), "round")
FUNCTIONS["CEIL"] = _rounding(F.ceil, "ceil")
FUNCTIONS["FLOOR"] = _rounding(F.floor, "floor")


def _hash(make):
    return lambda s, a: Val("str", make(F.encode(string_of(a), "UTF-8")))


FUNCTIONS["MD5"] = _hash(F.md5)
FUNCTIONS["SHA1"] = _hash(F.sha1)
FUNCTIONS["SHA256"] = _hash(lambda c: F.sha2(c, 256))
FUNCTIONS["SHA384"] = _hash(lambda c: F.sha2(c, 384))
FUNCTIONS["SHA512"] = _hash(lambda c: F.sha2(c, 512))


@function("LANGMATCHES")
def _(s, tag, rng):
    t, r = F.lower(string_of(tag)), F.lower(string_of(rng))
    return Val("bool", F.when(r == "*", t != "").otherwise((t == r) | F.startswith(t, F.concat(r, F.lit("-")))))


@function("SAMETERM")
def _(s, a, b):
    if a.kind == b.kind and a.kind != "term" and a.kind not in ("dbl", "flt"):
        return Val("bool", a.col == b.col)
    return Val("bool", as_term(a) == as_term(b))


@function("STRLANG")
def _(s, a, lang):
    return Val("term", R.make(2, _simple(a), R.LANG_STRING, F.lower(string_of(lang))))


@function("STRLANGDIR")
def _(s, a, lang, way):
    w = string_of(way)
    return Val("term", F.when(w.isin("ltr", "rtl"), R.make(2, _simple(a), R.DIR_LANG_STRING, F.lower(string_of(lang)), w)))


def _simple(a: Val) -> Column:
    return a.col if a.kind == "str" else F.when((as_term(a)["k"] == 2) & (as_term(a)["dt"] == R.STRING), as_term(a)["v"])


@function("STRDT")
def _(s, a, dt):
    return Val("term", R.make(2, _simple(a), F.when(is_kind(dt, 1), text_of(dt))))


@function("ENCODE_FOR_URI")
def _(s, a):
    # form encoding differs from percent encoding in these
    out = F.url_encode(string_of(a))
    for x, y in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(x), F.lit(y))
    return Val("str", out)


@function("IRI", "URI")
def _(s, a):
    if a.kind == "iri":
        return a
    if a.const is not None and a.const.k == 2:
        return constant(R.iri(a.const.v, s.base, check=False))
    text = F.coalesce(string_of(a), F.when(is_kind(a, 1), text_of(a)))
    if s.base:
        root = s.base.partition("#")[0]
        folder = root[: root.rfind("/") + 1] if root.count("/") > 2 else root + "/"
        host = "/".join(root.split("/")[:3])
        joined = F.when(text.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), text).when(text == "", root).when(text.startswith("#"), F.concat(F.lit(root), text))
        text = joined.when(text.startswith("/"), F.concat(F.lit(host), text)).otherwise(F.concat(F.lit(folder), text))
    return Val("iri", text)


@function("BNODE")
def _(s, a=None):
    label = F.concat(F.lit("b"), F.replace(F.expr("uuid()"), F.lit("-"))) if a is None else F.concat(F.lit("s"), F.md5(F.concat_ws("|", string_of(a), *[c for c in s.vars and [F.to_json(F.struct(*[as_term(v) for v in s.vars.values()]))] or []])))
    return Val("term", R.make(0, label))


@function("NOW")
def _(s):
    return constant(Term(2, s.now, R.DATETIME))


@function("RAND")
def _(s):
    return Val("dbl", F.rand())


@function("UUID")
def _(s):
    return Val("iri", F.concat(F.lit("urn:uuid:"), F.expr("uuid()")))


@function("STRUUID")
def _(s):
    return Val("str", F.expr("uuid()"))


def _date_part(native, dated: bool, pattern: str, kind: str):
    """Parts come from the lexical form, in its own offset."""

    def f(s, a):
        if a.kind == "dt" or a.kind == "date" and dated:
            return Val(kind, native(a.col).cast("bigint") if kind == "int" else native(a.col))
        if a.kind != "term":
            return Val(kind, F.lit(None).cast("bigint" if kind == "int" else "decimal(18,6)"))
        c = a.col
        types = [R.DATETIME, R.DATE] if dated else [R.DATETIME, R.TIME]
        part = F.regexp_extract(c["v"], pattern, 1)
        return Val(kind, F.when((c["k"] == 2) & c["dt"].isin(*types) & instant(a).isNotNull(), part.try_cast("bigint" if kind == "int" else "decimal(18,6)")))

    return f


FUNCTIONS["YEAR"] = _date_part(F.year, True, r"^(-?\d{4,})-", "int")
FUNCTIONS["MONTH"] = _date_part(F.month, True, r"^-?\d{4,}-(\d\d)-", "int")
FUNCTIONS["DAY"] = _date_part(F.day, True, r"^-?\d{4,}-\d\d-(\d\d)", "int")
FUNCTIONS["HOURS"] = _date_part(F.hour, False, r"(?:^|T)(\d\d):", "int")
FUNCTIONS["MINUTES"] = _date_part(F.minute, False, r"(?:^|T)\d\d:(\d\d):", "int")
FUNCTIONS["SECONDS"] = _date_part(lambda c: F.date_format(c, "ss.SSSSSS").cast("decimal(18,6)"), False, r"(?:^|T)\d\d:\d\d:(\d\d(?:\.\d+)?)", "dec")


def _offset(a: Val) -> Column:
    if a.kind in ("dt", "date"):
        return F.when(a.col.isNotNull(), "")
    t = as_term(a)
    return F.when((t["k"] == 2) & t["dt"].isin(R.DATETIME, R.DATE, R.TIME), F.regexp_extract(t["v"], r"(Z|[+-]\d\d:\d\d)$", 1))


@function("TZ")
def _(s, a):
    return Val("str", _offset(a))


@function("TIMEZONE")
def _(s, a):
    z = _offset(a)
    h, m = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    text = F.concat(
        F.when(z.startswith("-"), "-").otherwise(""), F.lit("PT"), F.when(h != 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m != 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(F.when(h == 0, "0S").otherwise(""))
    )
    text = F.when(z == "Z", "PT0S").when(z == "", None).otherwise(text)
    return Val("term", R.make(2, text, R.XSD + "dayTimeDuration"))


@function("TRIPLE")
def _(s, a, p, o):
    subject, predicate = as_term(a), as_term(p)
    ok = subject["k"].isin(0, 1, 3) & (predicate["k"] == 1)
    return Val("term", F.when(ok, R.triple_column(subject, predicate["v"], as_term(o))))


@function("SUBJECT")
def _(s, a):
    return Val("term", R.parts_column(as_term(a))["s"])


@function("PREDICATE")
def _(s, a):
    return Val("iri", R.parts_column(as_term(a))["p"])


@function("OBJECT")
def _(s, a):
    return Val("term", R.parts_column(as_term(a))["o"])


def _cast(name: str, args: list[Val]) -> Val:
    if len(args) != 1 or not name.startswith(R.XSD):
        return null_val()
    a, to = args[0], name[len(R.XSD) :]
    rank, dec, dbl = number(a)
    text = F.when(is_kind(a, 2), text_of(a))
    bare = F.trim(text)
    truth = a.col if a.kind == "bool" else F.when(as_term(a)["dt"] == R.BOOLEAN, as_term(a)["v"].isin("true", "1"))
    special = F.when(bare.isin("INF", "+INF"), F.lit(float("inf"))).when(bare == "-INF", F.lit(float("-inf"))).when(bare == "NaN", F.lit(float("nan")))
    stringish = F.coalesce(string_of(a))
    if to in ("integer", "int", "long"):
        if a.kind == "int":
            out = a.col
        else:
            parsed = F.when(F.trim(stringish).rlike(r"^[+-]?\d+$"), F.trim(stringish).try_cast("bigint"))
            out = F.coalesce(truth.cast("bigint"), F.when(rank <= 2, dec.try_cast("bigint")).when(rank > 2, F.when(~F.isnan(dbl) & (F.abs(dbl) < 9.2e18), dbl).try_cast("bigint")), parsed)
        return Val("int", out) if to == "integer" else Val("term", R.make(2, out.cast("string"), name))
    if to == "decimal":
        if a.kind == "dec":
            return a
        parsed = F.when(F.trim(stringish).rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), F.trim(stringish).try_cast("decimal(38,10)"))
        return Val("dec", F.coalesce(truth.cast("int").cast("decimal(38,10)"), dec, F.when(rank > 2, dbl.try_cast("decimal(38,10)")), parsed))
    if to in ("double", "float"):
        parsed = F.when(F.trim(stringish).rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), F.trim(stringish).try_cast("double"))
        out = F.coalesce(truth.cast("int").cast("double"), dbl, parsed, F.when(stringish.isNotNull(), special))
        return Val("dbl" if to == "double" else "flt", out)
    if to == "boolean":
        word = F.lower(F.trim(stringish))
        return Val("bool", F.coalesce(truth, F.when(rank.isNotNull(), (dbl != 0) & ~F.isnan(dbl)), F.when(word.isin("true", "1"), True).when(word.isin("false", "0"), False)))
    if to == "string":
        if a.kind != "term":
            return Val("str", lexical(a))
        canonical = F.when(rank == 1, dec.cast("decimal(38,0)").cast("string")).when(rank == 2, decimal_text(dec)).when(rank > 2, double_text(dbl)).when(truth.isNotNull(), truth.cast("string"))
        return Val("str", F.coalesce(canonical, text_of(a)))
    if to in ("dateTime", "date", "time"):
        if a.kind == "dt" and to == "dateTime":
            return a
        if a.kind == "dt" and to == "date":
            return Val("date", a.col.cast("date"))
        zone = F.regexp_extract(text, r"(Z|[+-]\d\d:\d\d)$", 1)
        v = text
        if to == "date":
            v = F.when(text.contains("T"), F.concat(F.substring_index(text, "T", 1), zone)).otherwise(text)
        if to == "dateTime":
            v = F.when(text.contains("T"), text).otherwise(F.concat(F.regexp_replace(text, r"(Z|[+-]\d\d:\d\d)$", ""), F.lit("T00:00:00"), zone))
        if to == "time":
            v = F.when(text.contains("T"), F.substring_index(text, "T", -1)).otherwise(text)
        t = R.make(2, v, name)
        return Val("term", F.when(instant(Val("term", t)).isNotNull(), t))
    return null_val()
