"""SPARQL 1.1/1.2 text to an algebra of plain tuples.

Patterns: ("bgp", triples), ("path", s, path, o), ("join", a, b), ("optional", a, b), ("union", a, b), ("minus", a, b),
("filter", expr, a), ("bind", a, var, expr), ("values", vars, rows), ("graph", term, a), ("select", Query).
A node of a triple is a Term, ("var", name) or ("tt", s, p, o). Paths: ("link", iri), ("inv", p), ("seq", a, b),
("alt", a, b), ("star", p), ("plus", p), ("opt", p), ("neg", forward iris, inverse iris).
Expressions: see Parser.expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from .. import terms as R
from ..terms import Term

AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "GROUP_CONCAT", "SAMPLE"}
#: Number of arguments of each built-in function (least, most).
BUILTINS = {
    **dict.fromkeys(
        "ISIRI ISURI ISBLANK ISLITERAL ISNUMERIC ISTRIPLE STR STRLEN UCASE LCASE LANG DATATYPE ABS ROUND CEIL FLOOR MD5 SHA1 SHA256 SHA384 SHA512 "
        "ENCODE_FOR_URI IRI URI YEAR MONTH DAY HOURS MINUTES SECONDS TIMEZONE TZ SUBJECT PREDICATE OBJECT LANGDIR HASLANG HASLANGDIR BOUND".split(),
        (1, 1),
    ),
    **dict.fromkeys("STRSTARTS STRENDS CONTAINS LANGMATCHES SAMETERM STRLANG STRDT STRBEFORE STRAFTER".split(), (2, 2)),
    **dict.fromkeys("IF TRIPLE STRLANGDIR".split(), (3, 3)),
    **dict.fromkeys("NOW RAND UUID STRUUID".split(), (0, 0)),
    "SUBSTR": (2, 3), "REGEX": (2, 3), "REPLACE": (3, 4), "CONCAT": (0, 999), "COALESCE": (0, 999), "BNODE": (0, 1),
}


class SparqlError(ValueError):
    """A request that isn't well formed."""


@dataclass
class Query:
    form: str  # SELECT, ASK, CONSTRUCT
    where: tuple = ("bgp", ())
    items: list = field(default_factory=list)  # (name, expr or None); empty with star
    star: bool = False
    distinct: bool = False
    group: list = field(default_factory=list)  # (expr, name or None)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)  # (expr, ascending)
    limit: int | None = None
    offset: int = 0
    template: list = field(default_factory=list)  # triples
    values: tuple | None = None
    from_: list = field(default_factory=list)
    from_named: list = field(default_factory=list)
    base: str = ""


@dataclass
class Update:
    kind: str
    delete: list = field(default_factory=list)  # quads: (graph or None, s, p, o)
    insert: list = field(default_factory=list)
    where: tuple | None = None
    with_: str | None = None
    using: list = field(default_factory=list)
    using_named: list = field(default_factory=list)
    target: str | None = None  # graph IRI, DEFAULT, NAMED, ALL
    source: str | None = None
    silent: bool = False
    base: str = ""


_TOKEN = re.compile(
    r"""
    (?P<ws>[\x20\t\r\n]+|\#[^\r\n]*)
  | (?P<iri><(?:[^<>"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
  | (?P<var>[?$][A-Za-z0-9_·-￿]+)
  | (?P<str>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|"(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*')
  | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*(?:--(?:[A-Za-z]+))?)
  | (?P<num>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)
  | (?P<bnode>_:[A-Za-z0-9_·-￿](?:[A-Za-z0-9_\-·-￿.]*[A-Za-z0-9_\-·-￿])?)
  | (?P<pname>(?:[A-Za-zÀ-￿](?:[A-Za-z0-9_\-·-￿.]*[A-Za-z0-9_\-·-￿])?)?:(?:(?:[A-Za-z0-9_:·-￿]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[A-Za-z0-9_:\-.·-￿]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[A-Za-z0-9_:\-·-￿]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
  | (?P<word>[A-Za-z][A-Za-z0-9_]*)
  | (?P<op><<\(|\)>>|<<|>>|\{\||\|\}|\^\^|&&|\|\||!=|<=|>=|[{}()\[\],;.=<>+\-*/!|^?~])
    """,
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(s: str) -> str:
    def one(m):
        if m[1]:
            return chr(int(m[1], 16))
        if m[2]:
            return chr(int(m[2], 16))
        if m[3] not in _ESCAPES:
            raise SparqlError(f"bad escape \\{m[3]}")
        return _ESCAPES[m[3]]

    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", one, s, flags=re.S) if "\\" in s else s




def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SparqlError(f"unexpected {text[at : at + 20]!r}")
        if m.lastgroup != "ws":
            out.append((m.lastgroup, m[0]))
        at = m.end()
    out.append(("end", ""))
    return out


class Parser:
    def __init__(self, text: str, base: str = "", prefixes: dict[str, str] | None = None):
        self.t, self.i = tokens(text), 0
        self.base, self.prefixes = base, dict(prefixes or {})
        self.fresh, self.labels, self.in_template = 0, {}, False
        self.banned_labels: set[str] = set()

    # tokens
    @property
    def tok(self) -> str:
        return self.t[self.i][1]

    @property
    def kind(self) -> str:
        return self.t[self.i][0]

    def next(self) -> str:
        self.i += 1
        return self.t[self.i - 1][1]

    def at(self, *words: str) -> bool:
        k, v = self.t[self.i]
        return k in ("op", "word") and v.upper() in words

    def take(self, *words: str) -> str | None:
        return self.next().upper() if self.at(*words) else None

    def need(self, word: str) -> None:
        if not self.take(word):
            raise SparqlError(f"expected {word}, found {self.tok!r}")

    def var(self) -> str:
        if self.kind != "var":
            raise SparqlError(f"expected a variable, found {self.tok!r}")
        return self.next()[1:]

    def new_var(self, hint: str = "b") -> tuple:
        self.fresh += 1
        return ("var", f".{hint}{self.fresh}")

    # prologue
    def prologue(self) -> None:
        while self.at("PREFIX", "BASE", "VERSION"):
            what = self.next().upper()
            if what == "BASE":
                self.base = R.resolve(self.base, self._iriref())
            elif what == "VERSION":
                if self.kind != "str":
                    raise SparqlError("VERSION needs a string")
                self.next()
            else:
                name = self.next()
                if not name.endswith(":"):
                    raise SparqlError(f"bad prefix {name!r}")
                self.prefixes[name[:-1]] = R.resolve(self.base, self._iriref())

    def _iriref(self) -> str:
        if self.kind != "iri":
            raise SparqlError(f"expected an IRI, found {self.tok!r}")
        return unescape(self.next()[1:-1])

    def iri(self) -> str:
        if self.kind == "iri":
            return R.resolve(self.base, self._iriref())
        if self.kind == "pname":
            prefix, _, local = self.next().partition(":")
            if prefix not in self.prefixes:
                raise SparqlError(f"undeclared prefix {prefix}:")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise SparqlError(f"expected an IRI, found {self.tok!r}")

    # entry
    def query(self) -> Query:
        self.prologue()
        q = Query(form=(self.take("SELECT", "ASK", "CONSTRUCT") or ""), base=self.base)
        if not q.form:
            raise SparqlError(f"unsupported query form {self.tok!r}")
        short = False
        if q.form == "SELECT":
            self._select(q)
        elif q.form == "CONSTRUCT":
            if self.at("{"):
                q.template = self._template()
            else:
                short = True
        self._dataset(q)
        self.take("WHERE")
        if short and not self.at("{"):
            raise SparqlError("CONSTRUCT needs a template or WHERE")
        q.where = self.group()
        if short:
            q.template = self._plain(q.where)
        self._modifiers(q)
        self._check(q)
        if self.kind != "end":
            raise SparqlError(f"unexpected {self.tok!r}")
        return q

    def _dataset(self, q: Query) -> None:
        while self.take("FROM"):
            (q.from_named if self.take("NAMED") else q.from_).append(self.iri())

    def _plain(self, where: tuple) -> list:
        if where[0] != "bgp":
            raise SparqlError("only a plain basic graph pattern may stand here")
        return list(where[1])

    def _select(self, q: Query) -> None:
        q.distinct = self.take("DISTINCT", "REDUCED") == "DISTINCT"
        if self.take("*"):
            q.star = True
            return
        while True:
            if self.kind == "var":
                q.items.append((self.var(), None))
            elif self.take("("):
                e = self.expression()
                self.need("AS")
                q.items.append((self.var(), e))
                self.need(")")
            else:
                break
        if not q.items:
            raise SparqlError("SELECT needs variables")
        if len({n for n, _ in q.items if _ is not None}) < sum(1 for _, e in q.items if e is not None):
            raise SparqlError("a variable is assigned twice")

    def _modifiers(self, q: Query) -> None:
        if self.take("GROUP"):
            self.need("BY")
            while True:
                if self.kind == "var":
                    q.group.append((("var", self.var()), None))
                elif self.take("("):
                    e = self.expression()
                    name = self.var() if self.take("AS") else None
                    self.need(")")
                    q.group.append((e, name))
                elif self.kind in ("word", "iri", "pname") and not self.at("HAVING", "ORDER", "LIMIT", "OFFSET", "VALUES"):
                    q.group.append((self._call(), None))
                else:
                    break
            if not q.group:
                raise SparqlError("GROUP BY needs a condition")
        if self.take("HAVING"):
            while self.at("(") or self.kind in ("iri", "pname") or self.kind == "word" and not self.at("ORDER", "LIMIT", "OFFSET", "VALUES"):
                q.having.append(self._constraint())
            if not q.having:
                raise SparqlError("HAVING needs a condition")
        if self.take("ORDER"):
            self.need("BY")
            while True:
                way = self.take("ASC", "DESC")
                if way:
                    self.need("(")
                    q.order.append((self.expression(), way == "ASC"))
                    self.need(")")
                elif self.kind == "var":
                    q.order.append((("var", self.var()), True))
                elif self.at("(") or self.kind in ("iri", "pname") or self.kind == "word" and not self.at("LIMIT", "OFFSET", "VALUES"):
                    q.order.append((self._constraint(), True))
                else:
                    break
            if not q.order:
                raise SparqlError("ORDER BY needs a condition")
        while self.at("LIMIT", "OFFSET"):
            what = self.next().upper()
            if self.kind != "num" or not self.tok.isdigit():
                raise SparqlError(f"{what} needs a whole number")
            if what == "LIMIT":
                q.limit = int(self.next())
            else:
                q.offset = int(self.next())
        if self.at("VALUES", "BINDINGS"):
            self.next()
            q.values = self._values()

    def _check(self, q: Query) -> None:
        grouped = bool(q.group) or any(has_aggregate(e) for _, e in q.items if e) or bool(q.having) or any(has_aggregate(e) for e, _ in q.order)
        if grouped and q.star:
            raise SparqlError("SELECT * can't be grouped")
        scope = pattern_vars(q.where)
        for name, e in q.items:
            if e is not None and name in scope and not (grouped and name not in scope):
                raise SparqlError(f"?{name} is already in scope")
        if grouped:
            keys = {e[1] for e, n in q.group if e[0] == "var"} | {n for _, n in q.group if n}
            known = set(keys)
            for name, e in q.items:
                if e is None:
                    if name not in known:
                        raise SparqlError(f"?{name} is not grouped")
                else:
                    loose = free_outside_aggregates(e) - known
                    if loose and not any(e == g for g, _ in q.group):
                        raise SparqlError(f"?{sorted(loose)[0]} is not grouped")
                    known.add(name)

    # patterns
    def group(self) -> tuple:
        self.need("{")
        if self.at("SELECT"):
            self.next()
            q = Query(form="SELECT", base=self.base)
            self._select(q)
            self.take("WHERE")
            q.where = self.group()
            self._modifiers(q)
            self._check(q)
            self.need("}")
            return ("select", q)
        out: tuple | None = None
        filters = []
        joined = lambda a, b: b if a is None else ("bgp", a[1] + b[1]) if a[0] == b[0] == "bgp" else ("join", a, b)
        while not self.at("}"):
            if self.take("FILTER"):
                filters.append(self._constraint())
            elif self.take("OPTIONAL"):
                out = ("optional", out or ("bgp", ()), self.group())
            elif self.take("MINUS"):
                out = ("minus", out or ("bgp", ()), self.group())
            elif self.take("BIND"):
                self.need("(")
                e = self.expression()
                self.need("AS")
                v = self.var()
                self.need(")")
                if out is not None and v in pattern_vars(out):
                    raise SparqlError(f"BIND to ?{v}, which is in scope")
                out = ("bind", out or ("bgp", ()), v, e)
            elif self.at("VALUES"):
                self.next()
                out = joined(out, self._values())
            elif self.take("GRAPH"):
                g = ("var", self.var()) if self.kind == "var" else Term(1, self.iri())
                out = joined(out, ("graph", g, self.group()))
            elif self.at("SERVICE"):
                raise SparqlError("SERVICE is not supported")
            elif self.at("{"):
                p = self.group()
                while self.take("UNION"):
                    p = ("union", p, self.group())
                if p[0] == "bgp":
                    p = ("group", p)  # its own scope
                out = joined(out, p)
            elif self.take("."):
                continue
            else:
                for p in self._triples_block():
                    out = joined(out, p)
        self.need("}")
        out = out or ("bgp", ())
        for f in filters:
            out = ("filter", f, out)
        return out

    def _constraint(self) -> tuple:
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        if self.at("NOT", "EXISTS"):
            return self._exists()
        return self._call()

    def _exists(self) -> tuple:
        negated = bool(self.take("NOT"))
        self.need("EXISTS")
        return ("exists", self.group(), negated)

    def _values(self) -> tuple:
        if self.kind == "var":
            names, one = [self.var()], True
        else:
            self.need("(")
            names, one = [], False
            while self.kind == "var":
                names.append(self.var())
            self.need(")")
        if len(set(names)) < len(names):
            raise SparqlError("VALUES repeats a variable")
        self.need("{")
        rows = []
        while not self.take("}"):
            if one:
                rows.append((self._data_value(),))
                continue
            self.need("(")
            row = []
            while not self.take(")"):
                row.append(self._data_value())
            if len(row) != len(names):
                raise SparqlError("VALUES row of another length")
            rows.append(tuple(row))
        return ("values", tuple(names), tuple(rows))

    def _data_value(self):
        if self.take("UNDEF"):
            return None
        n = self.node([])
        if not isinstance(n, Term) or n.k == 0:
            raise SparqlError("VALUES takes constants")
        return n

    # triples
    def _triples_block(self) -> list[tuple]:
        """Patterns of a run of triples: one bgp and the paths."""
        triples: list = []
        self._same_subject(triples, paths=True)
        while self.take("."):
            if self.at("}", "FILTER", "OPTIONAL", "MINUS", "BIND", "VALUES", "GRAPH", "{", "SERVICE") or self.kind == "end":
                break
            self._same_subject(triples, paths=True)
        out, bgp = [], tuple(t for t in triples if len(t) == 3)
        if bgp:
            out.append(("bgp", bgp))
        out += [("path", s, p, o) for _, s, p, o in (t for t in triples if len(t) == 4)]
        return out

    def _same_subject(self, out: list, paths: bool) -> None:
        if self.at("[") or self.at("(") or self.at("<<"):
            before = len(out)
            s = self.node(out)
            if self.at(".", "}", "|}") and (len(out) > before or isinstance(s, tuple)):
                return
            self._predicates(s, out, paths, optional=True)
        else:
            s = self.node(out)
            if isinstance(s, Term) and s.k == 2:
                raise SparqlError("a literal can't be a subject")
            self._predicates(s, out, paths)

    def _predicates(self, s, out: list, paths: bool, optional: bool = False) -> None:
        if optional and self.at(".", "}", "]"):
            return
        while True:
            p = self._verb(paths)
            while True:
                o = self.node(out)
                simple = not isinstance(p, tuple) or p[0] == "var"
                out.append((s, p, o) if simple else ("path", s, p, o))
                self._annotations(s, p, o, out, simple)
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.at(".", "}", "]", "|}") or self.kind == "end":
                return

    def _annotations(self, s, p, o, out: list, simple: bool) -> None:
        reifier = None
        while self.at("~", "{|"):
            if not simple:
                raise SparqlError("a path can't be annotated")
            if self.take("~"):
                reifier = self.node(out) if self.kind in ("var", "iri", "pname", "bnode") else self._blank()
                out.append((reifier, Term(1, R.REIFIES), ("tt", s, p, o)))
            else:
                self.need("{|")
                if reifier is None:
                    reifier = self._blank()
                    out.append((reifier, Term(1, R.REIFIES), ("tt", s, p, o)))
                self._predicates(reifier, out, False)
                self.need("|}")
                reifier = None

    def _blank(self, label: str | None = None):
        if self.in_template:
            self.fresh += 1
            return Term(0, label or f".{self.fresh}")
        if label is None:
            return self.new_var()
        return ("var", f".bn_{label}")

    def _verb(self, paths: bool):
        if self.kind == "var":
            return ("var", self.var())
        if not paths:
            if self.kind == "word" and self.tok == "a":
                self.next()
                return Term(1, R.TYPE)
            return Term(1, self.iri())
        p = self.path()
        return Term(1, p[1]) if p[0] == "link" else p

    def path(self) -> tuple:
        out = self._path_seq()
        while self.take("|"):
            out = ("alt", out, self._path_seq())
        return out

    def _path_seq(self) -> tuple:
        out = self._path_elt()
        while self.take("/"):
            out = ("seq", out, self._path_elt())
        return out

    def _path_elt(self) -> tuple:
        inverse = bool(self.take("^"))
        if self.take("!"):
            out = self._negated()
        elif self.take("("):
            out = self.path()
            self.need(")")
        elif self.kind == "word" and self.tok == "a":
            self.next()
            out = ("link", R.TYPE)
        else:
            out = ("link", self.iri())
        mod = self.take("*", "+", "?")
        if mod:
            out = ({"*": "star", "+": "plus", "?": "opt"}[mod], out)
        return ("inv", out) if inverse else out

    def _negated(self) -> tuple:
        forward, back = [], []

        def one():
            inverse = bool(self.take("^"))
            if self.kind == "word" and self.tok == "a":
                self.next()
                x = R.TYPE
            else:
                x = self.iri()
            (back if inverse else forward).append(x)

        if self.take("("):
            if not self.at(")"):
                one()
                while self.take("|"):
                    one()
            self.need(")")
        else:
            one()
        return ("neg", tuple(forward), tuple(back))

    def node(self, out: list):
        """A term of a triple; what it implies (lists, property lists, reifiers) goes to out."""
        k = self.kind
        if k == "var":
            return ("var", self.var())
        if k in ("iri", "pname"):
            return Term(1, self.iri())
        if k == "bnode":
            label = self.next()[2:]
            if label in self.banned_labels:
                raise SparqlError(f"blank node label {label} is used in another operation or scope")
            return self.labels.setdefault(label, self._blank(label))
        if k in ("str", "num") or self.at("TRUE", "FALSE") or self.at("+", "-"):
            return self.literal()
        if self.take("["):
            b = self._blank()
            if not self.at("]"):
                self._predicates(b, out, not self.in_template)
            self.need("]")
            return b
        if self.take("("):
            items = []
            while not self.take(")"):
                items.append(self.node(out))
            head = Term(1, R.NIL)
            for x in reversed(items):
                cell = self._blank()
                out += [(cell, Term(1, R.FIRST), x), (cell, Term(1, R.REST), head)]
                head = cell
            return head
        if self.take("<<("):
            s = self.node(out)
            p = self._verb(False)
            o = self.node(out)
            self.need(")>>")
            if isinstance(s, Term) and isinstance(p, Term) and isinstance(o, Term) and (s.k or self.in_template):
                if s.k == 2:
                    raise SparqlError("a literal can't be a subject")
                return R.triple_term(s, p.v, o) if all(x.k for x in (s, o)) else ("tt", s, p, o)
            return ("tt", s, p, o)
        if self.take("<<"):
            s = self.node(out)
            p = self._verb(False)
            o = self.node(out)
            reifier = None
            if self.take("~"):
                reifier = self._blank() if self.at(">>") else self.node(out)
            self.need(">>")
            reifier = reifier or self._blank()
            out.append((reifier, Term(1, R.REIFIES), ("tt", s, p, o)))
            return reifier
        raise SparqlError(f"unexpected {self.tok!r}")

    def literal(self) -> Term:
        sign = self.next() if self.at("+", "-") else ""
        if self.kind == "num":
            v = self.next()
            dt = R.DOUBLE if "e" in v.lower() else R.DECIMAL if "." in v else R.INTEGER
            return Term(2, sign + v, dt)
        if sign:
            raise SparqlError("expected a number")
        if self.at("TRUE", "FALSE"):
            return Term(2, self.next().lower(), R.BOOLEAN)
        if self.kind != "str":
            raise SparqlError(f"expected a literal, found {self.tok!r}")
        raw = self.next()
        n = 3 if raw[:3] in ('"""', "'''") else 1
        v = unescape(raw[n:-n])
        if self.kind == "lang":
            lang, _, way = self.next()[1:].partition("--")
            if way and way not in ("ltr", "rtl"):
                raise SparqlError(f"bad direction {way}")
            return R.literal(v, lang=lang, dir=way)
        if self.take("^^"):
            return Term(2, v, self.iri())
        return Term(2, v, R.STRING)

    def _template(self) -> list:
        self.in_template, labels = True, self.labels
        self.labels = {}
        self.need("{")
        out: list = []
        while not self.at("}"):
            self._same_subject(out, paths=False)
            if not self.take(".") and not self.at("}"):
                raise SparqlError(f"unexpected {self.tok!r}")
        self.need("}")
        self.in_template, self.labels = False, labels
        return out

    # expressions
    def expression(self) -> tuple:
        """("var", n) ("term", Term) ("op", sign, a, b) ("not", e) ("neg", e) ("in", e, list, negated)
        ("exists", pattern, negated) ("call", NAME, args) ("cast", iri, args) ("agg", NAME, distinct, e, separator)."""
        out = self._and()
        while self.take("||"):
            out = ("op", "||", out, self._and())
        return out

    def _and(self) -> tuple:
        out = self._relation()
        while self.take("&&"):
            out = ("op", "&&", out, self._relation())
        return out

    def _relation(self) -> tuple:
        a = self._sum()
        op = self.take("=", "!=", "<", ">", "<=", ">=")
        if op:
            return ("op", op, a, self._sum())
        if self.at("IN") or self.at("NOT") and self.t[self.i + 1][1].upper() == "IN":
            negated = bool(self.take("NOT"))
            self.need("IN")
            self.need("(")
            items = []
            while not self.take(")"):
                items.append(self.expression())
                if not self.at(")"):
                    self.need(",")
            return ("in", a, tuple(items), negated)
        return a

    def _sum(self) -> tuple:
        out = self._product()
        while self.at("+", "-"):
            op = self.next()
            out = ("op", op, out, self._product())
        return out

    def _product(self) -> tuple:
        out = self._unary()
        while self.at("*", "/"):
            op = self.next()
            out = ("op", op, out, self._unary())
        return out

    def _unary(self) -> tuple:
        if self.take("!"):
            return ("not", self._unary())
        if self.at("-") and self.t[self.i + 1][0] != "num":
            self.next()
            return ("neg", self._unary())
        if self.at("+") and self.t[self.i + 1][0] != "num":
            self.next()
            return self._unary()
        return self._primary()

    def _primary(self) -> tuple:
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        if self.kind == "var":
            return ("var", self.var())
        if self.kind in ("str", "num") or self.at("TRUE", "FALSE", "+", "-"):
            return ("term", self.literal())
        if self.at("NOT", "EXISTS"):
            return self._exists()
        if self.at("<<("):
            return self._tt_expression()
        return self._call()

    def _tt_expression(self) -> tuple:
        self.need("<<(")
        part = lambda: self._tt_expression() if self.at("<<(") else ("var", self.var()) if self.kind == "var" else ("term", self.node([]))
        s = part()
        p = self._verb(False)
        o = part()
        self.need(")>>")
        return ("call", "TRIPLE", (s, p if isinstance(p, tuple) else ("term", p), o))

    def _call(self) -> tuple:
        if self.kind in ("iri", "pname"):
            name = self.iri()
            if not self.at("("):
                return ("term", Term(1, name))
            return ("cast", name, tuple(self._args()))
        if self.kind != "word":
            raise SparqlError(f"unexpected {self.tok!r}")
        name = self.next().upper()
        if name in AGGREGATES:
            self.need("(")
            distinct = bool(self.take("DISTINCT"))
            e, sep = None, " "
            if name == "COUNT" and self.take("*"):
                pass
            else:
                e = self.expression()
                if has_aggregate(e):
                    raise SparqlError("aggregates can't be nested")
            if name == "GROUP_CONCAT" and self.take(";"):
                self.need("SEPARATOR")
                self.need("=")
                sep = self.literal().v
            self.need(")")
            return ("agg", name, distinct, e, sep)
        if name not in BUILTINS:
            raise SparqlError(f"unknown function {name}")
        args = self._args()
        low, high = BUILTINS[name]
        if not low <= len(args) <= high:
            raise SparqlError(f"{name} takes {low} to {high} arguments")
        if name == "BOUND" and args[0][0] != "var":
            raise SparqlError("BOUND takes a variable")
        return ("call", name, tuple(args))

    def _args(self) -> list:
        self.need("(")
        self.take("DISTINCT")
        out = []
        while not self.take(")"):
            out.append(self.expression())
            if not self.at(")"):
                self.need(",")
        return out

    # updates
    def update(self) -> list[Update]:
        out: list[Update] = []
        while True:
            self.prologue()
            if self.kind == "end":
                break
            u = self._operation()
            u.base = self.base
            out.append(u)
            if not self.take(";"):
                break
        if self.kind != "end":
            raise SparqlError(f"unexpected {self.tok!r}")
        return out

    def _operation(self) -> Update:
        self.banned_labels |= set(self.labels)
        self.labels = {}
        word = self.next().upper()
        if word in ("INSERT", "DELETE") and self.take("DATA"):
            quads = self._quads(template=True)
            ground = lambda n: isinstance(n, Term) or n[0] == "tt" and all(map(ground, n[1:]))
            flat = [x for g, *t in quads for x in ([g] if g else []) + t]
            if not all(map(ground, flat)):
                raise SparqlError("DATA takes no variables")
            if word == "DELETE" and any(isinstance(x, Term) and x.k == 0 for x in flat):
                raise SparqlError("DELETE DATA takes no blank nodes")
            return Update(f"{word} DATA", **{word.lower(): quads})
        if word == "DELETE" and self.take("WHERE"):
            mark, quads = self.i, self._quads(template=False)
            self.i = mark
            return Update("MODIFY", delete=quads, where=self.group())
        if word in ("WITH", "INSERT", "DELETE"):
            u = Update("MODIFY")
            if word == "WITH":
                u.with_ = self.iri()
                word = self.next().upper()
            if word == "DELETE":
                u.delete = self._quads(template=True)
                if any(isinstance(x, Term) and x.k == 0 for q in u.delete for x in q[1:]):
                    raise SparqlError("DELETE templates take no blank nodes")
                word = "INSERT" if self.take("INSERT") else ""
            if word == "INSERT":
                u.insert = self._quads(template=True)
            while self.take("USING"):
                (u.using_named if self.take("NAMED") else u.using).append(self.iri())
            self.need("WHERE")
            self.labels = {}
            u.where = self.group()
            return u
        silent = bool(self.take("SILENT"))
        if word in ("CLEAR", "DROP"):
            return Update(word, target=self._target(), silent=silent)
        if word == "CREATE":
            self.need("GRAPH")
            return Update(word, target=self.iri(), silent=silent)
        if word == "LOAD":
            source, target = self.iri(), None
            if self.take("INTO"):
                self.need("GRAPH")
                target = self.iri()
            return Update(word, source=source, target=target, silent=silent)
        if word in ("ADD", "COPY", "MOVE"):
            one = lambda: self.take("DEFAULT") or (self.take("GRAPH"), self.iri())[1]
            source = one()
            self.need("TO")
            return Update(word, source=source, target=one(), silent=silent)
        raise SparqlError(f"unknown operation {word}")

    def _target(self) -> str:
        got = self.take("DEFAULT", "NAMED", "ALL")
        if got:
            return got
        self.need("GRAPH")
        return self.iri()

    def _quads(self, template: bool) -> list:
        self.in_template = template
        self.need("{")
        out: list = []

        def triples(g):
            part: list = []
            while not self.at("}", "GRAPH"):
                self._same_subject(part, paths=False)
                if not self.take(".") and not self.at("}", "GRAPH"):
                    raise SparqlError(f"unexpected {self.tok!r}")
            out.extend((g, *t) for t in part)

        while not self.take("}"):
            if self.take("GRAPH"):
                g = ("var", self.var()) if self.kind == "var" else Term(1, self.iri())
                self.need("{")
                triples(g)
                self.need("}")
                self.take(".")
            else:
                triples(None)
        self.in_template = False
        return out


# analysis -------------------------------------------------------------------------------------------------------------


def node_vars(n) -> set[str]:
    if isinstance(n, Term) or n is None:
        return set()
    return {n[1]} if n[0] == "var" else set().union(*map(node_vars, n[1:]))


def pattern_vars(p: tuple) -> set[str]:
    """Variables in scope of a pattern."""
    kind = p[0]
    if kind == "bgp":
        return set().union(*(node_vars(n) for t in p[1] for n in t)) if p[1] else set()
    if kind == "path":
        return node_vars(p[1]) | node_vars(p[3])
    if kind in ("join", "optional", "union"):
        return pattern_vars(p[1]) | pattern_vars(p[2])
    if kind == "minus":
        return pattern_vars(p[1])
    if kind == "filter":
        return pattern_vars(p[2])
    if kind == "bind":
        return pattern_vars(p[1]) | {p[2]}
    if kind == "values":
        return set(p[1])
    if kind == "graph":
        return node_vars(p[1]) | pattern_vars(p[2])
    if kind == "group":
        return pattern_vars(p[1])
    q = p[1]
    return pattern_vars(q.where) if q.star else {n for n, _ in q.items}


def children(e: tuple) -> list[tuple]:
    kind = e[0]
    if kind in ("call", "cast"):
        return list(e[2])
    if kind == "op":
        return [e[2], e[3]]
    if kind in ("not", "neg"):
        return [e[1]]
    if kind == "in":
        return [e[1], *e[2]]
    if kind == "agg":
        return [e[3]] if e[3] else []
    return []


def expr_vars(e: tuple) -> set[str]:
    if e[0] == "var":
        return {e[1]}
    if e[0] == "exists":
        return inner_vars(e[1])
    return set().union(*map(expr_vars, children(e))) if children(e) else set()


def inner_vars(p: tuple) -> set[str]:
    """All variables that a pattern mentions, filters included."""
    out = pattern_vars(p) if p[0] != "select" else set()
    for x in p[1:]:
        if isinstance(x, tuple) and x and isinstance(x[0], str):
            if x[0] in ("bgp", "path", "join", "optional", "union", "minus", "filter", "bind", "values", "graph", "group"):
                out |= inner_vars(x)
            elif p[0] in ("filter", "bind") and x[0] in ("var", "term", "op", "not", "neg", "in", "exists", "call", "cast"):
                out |= expr_vars(x)
    return out


def has_aggregate(e: tuple) -> bool:
    return e[0] == "agg" or any(map(has_aggregate, children(e)))


def free_outside_aggregates(e: tuple) -> set[str]:
    if e[0] == "agg":
        return set()
    if e[0] in ("var", "exists"):
        return expr_vars(e) if e[0] == "var" else set()
    return set().union(*map(free_outside_aggregates, children(e))) if children(e) else set()


@lru_cache(maxsize=256)
def parse_query(text: str, base: str = "", prefixes: tuple = ()) -> Query:
    return Parser(text, base, dict(prefixes)).query()


def parse_update(text: str, base: str = "", prefixes: tuple = ()) -> list[Update]:
    return Parser(text, base, dict(prefixes)).update()
