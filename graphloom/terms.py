"""RDF terms: a Python value class and its column form.

A term column is struct<k, v, dt, lang, dir>: k is 0 blank node, 1 IRI, 2 literal, 3 triple term. Inner fields are never
null; a null struct is an unbound variable. Struct equality is term identity. A triple term keeps its parts as JSON in v.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass
from datetime import date, datetime, time
from decimal import Decimal
from functools import total_ordering
from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SH = "http://www.w3.org/ns/shacl#"
STRING, INTEGER, DECIMAL, FLOAT, DOUBLE, BOOLEAN, DATETIME, DATE, TIME = (XSD + n for n in ("string", "integer", "decimal", "float", "double", "boolean", "dateTime", "date", "time"))
LANG_STRING, DIR_LANG_STRING = RDF + "langString", RDF + "dirLangString"
TYPE, FIRST, REST, NIL, REIFIES = RDF + "type", RDF + "first", RDF + "rest", RDF + "nil", RDF + "reifies"
#: Integer types by their inclusive bounds (None: open).
INTEGER_BOUNDS = {
    XSD + n: b
    for n, b in {
        "integer": (None, None), "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-128, 127),
        "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1),
        "unsignedLong": (0, 2**64 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 2**16 - 1), "unsignedByte": (0, 255),
    }.items()
}
NUMERIC = (*INTEGER_BOUNDS, DECIMAL, FLOAT, DOUBLE)

TERM = T.StructType([T.StructField(n, T.ByteType() if n == "k" else T.StringType(), False) for n in ("k", "v", "dt", "lang", "dir")])
QUADS = T.StructType([T.StructField("g", T.StringType(), False), T.StructField("s", TERM, False), T.StructField("p", T.StringType(), False), T.StructField("o", TERM, False)])
TERM_DDL = "struct<k:tinyint,v:string,dt:string,lang:string,dir:string>"
TRIPLE_DDL = f"s {TERM_DDL}, p string, o {TERM_DDL}"

_BAD_IRI = re.compile(r"[\x00-\x20<>\"{}|^`\\]")
_LANG = re.compile(r"[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*\Z")


@total_ordering
@dataclass(frozen=True)
class Term:
    k: int
    v: str
    dt: str = ""
    lang: str = ""
    dir: str = ""

    def __lt__(self, other: "Term") -> bool:
        """Blank node < IRI < literal < triple term; numbers of one type by value, else by text."""
        if self.k == other.k == 2 and self.dt == other.dt and self.dt in NUMERIC:
            try:
                a, b = float(self.v), float(other.v)
                if a != b:
                    return a < b
            except ValueError:
                pass
        return (self.k, self.v, self.dt, self.lang, self.dir) < (other.k, other.v, other.dt, other.lang, other.dir)

    @property
    def n3(self) -> str:
        if self.k == 0:
            return "_:" + self.v
        if self.k == 1:
            return f"<{self.v}>"
        if self.k == 3:
            s, p, o = self.parts()
            return f"<<( {s.n3} <{p}> {o.n3} )>>"
        text = '"' + escape(self.v) + '"'
        if self.lang:
            return f"{text}@{self.lang}" + (f"--{self.dir}" if self.dir else "")
        return text if self.dt in ("", STRING) else f"{text}^^<{self.dt}>"

    def parts(self) -> tuple["Term", str, "Term"]:
        d = json.loads(self.v)
        return Term(**d["s"]), d["p"], Term(**d["o"])

    def value(self):
        """The host value of a literal (its text where its type isn't known or its form is wrong)."""
        if self.k != 2:
            return self.v
        try:
            if self.dt in INTEGER_BOUNDS:
                return int(self.v)
            if self.dt == DECIMAL:
                return Decimal(self.v)
            if self.dt in (FLOAT, DOUBLE):
                return float(self.v.replace("INF", "inf"))
            if self.dt == BOOLEAN:
                return {"true": True, "1": True, "false": False, "0": False}[self.v]
        except (ValueError, KeyError, ArithmeticError):
            pass
        return self.v

    def skolemize(self, authority: str = "http://example.org", path: str = "/.well-known/genid/") -> "Term":
        return Term(1, authority.rstrip("/") + path + self.v) if self.k == 0 else self

    def defrag(self) -> "Term":
        return Term(1, self.v.partition("#")[0])

    def fragment(self) -> str:
        return self.v.partition("#")[2]


def escape(s: str) -> str:
    out = s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t").replace("\b", "\\b").replace("\f", "\\f")
    return re.sub(r"[\x00-\x07\x0b\x0e-\x1f\x7f]", lambda m: f"\\u{ord(m[0]):04X}", out)


def iri(value: str, base: str = "", check: bool = True) -> Term:
    """An IRI, resolved against base; forbidden characters are an error."""
    if base:
        value = resolve(base, value)
    if check and _BAD_IRI.search(value):
        raise ValueError(f"not an IRI: {value!r}")
    return Term(1, value)


_SCHEME = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*:")


def resolve(base: str, ref: str) -> str:
    """RFC 3986 resolution."""
    if not base or _SCHEME.match(ref):
        return ref
    if not ref:
        return base.partition("#")[0]
    if ref[0] == "#":
        return base.partition("#")[0] + ref
    scheme, _, rest = base.partition(":")
    if not rest.startswith("/"):  # opaque base
        return base if not ref else scheme + ":" + ref
    joined = urljoin("http:" + rest, ref)
    return scheme + joined[4:] if joined.startswith("http:") else joined


def bnode(label: str | None = None) -> Term:
    return Term(0, label or "N" + uuid.uuid4().hex)


def literal(value, lang: str = "", dir: str = "", dt: str = "") -> Term:
    """A literal of a host value; its lexical form is kept, language tags are lowered, bad tags dropped."""
    if isinstance(value, Term):
        return value
    if lang and _LANG.match(lang):
        dir = dir if dir in ("ltr", "rtl") else ""
        return Term(2, str(value), DIR_LANG_STRING if dir else LANG_STRING, lang.lower(), dir)
    if dt:
        return Term(2, value if isinstance(value, str) else str(value), dt)
    if isinstance(value, bool):
        return Term(2, "true" if value else "false", BOOLEAN)
    if isinstance(value, int):
        return Term(2, str(value), INTEGER)
    if isinstance(value, float):
        return Term(2, "NaN" if value != value else "INF" if value == float("inf") else "-INF" if value == float("-inf") else repr(value), DOUBLE)
    if isinstance(value, Decimal):
        return Term(2, format(value, "f"), DECIMAL)
    if isinstance(value, datetime):
        return Term(2, value.isoformat(), DATETIME)
    if isinstance(value, date):
        return Term(2, value.isoformat(), DATE)
    if isinstance(value, time):
        return Term(2, value.isoformat(), TIME)
    return Term(2, str(value), STRING)


def triple_term(s: Term, p: str, o: Term) -> Term:
    part = lambda t: {"k": t.k, "v": t.v, "dt": t.dt, "lang": t.lang, "dir": t.dir}
    return Term(3, json.dumps({"s": part(s), "p": p, "o": part(o)}, ensure_ascii=False, separators=(",", ":")))


# columns --------------------------------------------------------------------------------------------------------------


def make(k: int, v: Column, dt: Column | str = "", lang: Column | str = "", dir: Column | str = "") -> Column:
    """A term column; null where v is null."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(v.isNotNull(), F.struct(F.lit(k).cast("tinyint").alias("k"), v.alias("v"), lit(dt).alias("dt"), lit(lang).alias("lang"), lit(dir).alias("dir")))


def const(t: Term) -> Column:
    return F.struct(F.lit(t.k).cast("tinyint").alias("k"), F.lit(t.v).alias("v"), F.lit(t.dt).alias("dt"), F.lit(t.lang).alias("lang"), F.lit(t.dir).alias("dir"))


def from_row(r) -> Term | None:
    return None if r is None else Term(r["k"], r["v"], r["dt"], r["lang"], r["dir"])


def triple_column(s: Column, p: Column, o: Column) -> Column:
    return make(3, F.when(s.isNotNull() & p.isNotNull() & o.isNotNull(), F.to_json(F.struct(s.alias("s"), p.alias("p"), o.alias("o")))))


def parts_column(t: Column) -> Column:
    """struct<s, p, o> of a triple term column."""
    return F.when(t["k"] == 3, F.from_json(t["v"], TRIPLE_DDL))


def escaped(v: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return v


def n3(t: Column, depth: int = 2) -> Column:
    """N-Triples text of a term column; triple terms nest `depth` deep."""
    suffix = F.when(t["lang"] != "", F.concat(F.lit("@"), t["lang"], F.when(t["dir"] != "", F.concat(F.lit("--"), t["dir"])).otherwise(""))).otherwise(
        F.when((t["dt"] == "") | (t["dt"] == STRING), "").otherwise(F.concat(F.lit("^^<"), t["dt"], F.lit(">")))
    )
    out = F.when(t["k"] == 0, F.concat(F.lit("_:"), t["v"])).when(t["k"] == 1, F.concat(F.lit("<"), t["v"], F.lit(">")))
    if depth:
        p = parts_column(t)
        out = out.when(t["k"] == 3, F.concat(F.lit("<<( "), n3(p["s"], depth - 1), F.lit(" <"), p["p"], F.lit("> "), n3(p["o"], depth - 1), F.lit(" )>>")))
    return F.when(t.isNotNull(), out.otherwise(F.concat(F.lit('"'), escaped(t["v"]), F.lit('"'), suffix)))


# namespaces -----------------------------------------------------------------------------------------------------------

#: Well-known prefixes.
PREFIXES = {
    "rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, "sh": SH,
    "foaf": "http://xmlns.com/foaf/0.1/", "dc": "http://purl.org/dc/elements/1.1/", "dcterms": "http://purl.org/dc/terms/",
    "skos": "http://www.w3.org/2004/02/skos/core#", "prov": "http://www.w3.org/ns/prov#", "sosa": "http://www.w3.org/ns/sosa/",
    "ssn": "http://www.w3.org/ns/ssn/", "dcat": "http://www.w3.org/ns/dcat#", "void": "http://rdfs.org/ns/void#",
}


class Namespace(str):
    """Terms of a vocabulary: ns.name or ns['name']; closed ones know only their names."""

    names: frozenset | None = None

    def __new__(cls, base: str, names=None):
        out = super().__new__(cls, base)
        out.names = frozenset(names) if names is not None else None
        return out

    def term(self, name: str) -> Term:
        if self.names is not None and name not in self.names:
            raise KeyError(f"{name} is not in {str(self)}")
        return Term(1, str(self) + name)

    def __getattr__(self, name: str) -> Term:
        if name.startswith("__"):
            raise AttributeError(name)
        return self.term(name)

    def __getitem__(self, name):
        return self.term(name) if isinstance(name, str) else str.__getitem__(self, name)


class Namespaces:
    """Prefixes of a graph: bind, expand, qname with generated prefixes."""

    def __init__(self, bound: dict[str, str] | None = None, base: str = ""):
        self.by, self.base = dict(bound or {}), base

    def bind(self, prefix: str, namespace: str, override: bool = True) -> None:
        if override or prefix not in self.by:
            self.by[prefix] = str(namespace)

    def expand(self, curie: str) -> Term:
        prefix, sep, local = curie.partition(":")
        if not sep or prefix not in self.by:
            raise KeyError(f"unknown prefix in {curie!r}")
        return Term(1, self.by[prefix] + local)

    def absolute(self, ref: str) -> Term:
        return Term(1, resolve(self.base, ref))

    def qname(self, value: str, generate: bool = False) -> str | None:
        """prefix:local by the longest namespace that fits and leaves a simple local name."""
        best = max((p for p, n in self.by.items() if n and value.startswith(n) and re.fullmatch(r"[\w][\w.-]*|", value[len(n) :]) and not value.endswith(".")), key=lambda p: len(self.by[p]), default=None)
        if best is not None:
            return f"{best}:{value[len(self.by[best]) :]}"
        if not generate:
            return None
        cut = max(value.rfind("#"), value.rfind("/"), value.rfind(":")) + 1
        if not cut or not re.fullmatch(r"[A-Za-z_][\w-]*", value[cut:]):
            return None
        n = next(i for i in range(1, 10**6) if f"ns{i}" not in self.by)
        self.by[f"ns{n}"] = value[:cut]
        return f"ns{n}:{value[cut:]}"
