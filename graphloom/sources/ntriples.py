"""N-Triples and N-Quads: line by line, so files split; plain lines are cut by Spark's own functions."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as R
from ..plans.parser import SparqlError, unescape
from ..terms import Term

_IRI = r"<(?:[^<>\"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>"
_LABEL = r"_:[^\s<>\"'@^(){},;.](?:[^\s<>\"'@^(){},;]*[^\s<>\"'@^(){},;.])?"
_TOKEN = re.compile(rf"\s*(?:({_IRI})|({_LABEL})|\"((?:[^\"\\\r\n]|\\.)*)\"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)(?:--(ltr|rtl))?|\s*\^\^\s*({_IRI}))?|(<<\()|(\)>>)|(\.)\s*(?:#.*)?$)")
_ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")

LINE = "g string, s {t}, p string, o {t}, error string".format(t=R.TERM_DDL)


def parse_line(line: str) -> tuple[Term, str, Term, str] | None:
    """(s, p, o, g) of a line; None for blank lines and comments; an error otherwise."""
    text = line.strip()
    if not text or text[0] == "#" or re.fullmatch(r"VERSION\s+([\"']).*\1\s*(#.*)?", text):
        return None
    at, out, stack = 0, [], []
    done = False
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SparqlError(f"unexpected {text[at : at + 20]!r}")
        at = m.end()
        here = stack[-1] if stack else out
        if m[1]:
            v = unescape(m[1][1:-1])
            if not _ABSOLUTE.match(v):
                raise SparqlError(f"relative IRI {v!r}")
            here.append(R.iri(v))
        elif m[2]:
            here.append(Term(0, m[2][2:]))
        elif m[3] is not None:
            v = unescape(m[3])
            here.append(R.literal(v, lang=m[4] or "", dir=m[5] or "") if m[4] else Term(2, v, unescape(m[6][1:-1]) if m[6] else R.STRING))
        elif m[7]:
            stack.append([])
        elif m[8]:
            if not stack or len(stack[-1]) != 3:
                raise SparqlError("bad triple term")
            s, p, o = stack.pop()
            if s.k == 2 or p.k != 1:
                raise SparqlError("bad triple term")
            (stack[-1] if stack else out).append(R.triple_term(s, p.v, o))
        else:
            done = True
            break
    if not done or stack or len(out) not in (3, 4):
        raise SparqlError("not a statement")
    s, p, o = out[:3]
    if s.k not in (0, 1) or p.k != 1 or len(out) == 4 and out[3].k not in (0, 1):
        raise SparqlError("term of the wrong kind")
    return s, p.v, o, (out[3].v if out[3].k == 1 else "") if len(out) == 4 else ""


def parse_term(text: str) -> Term:
    """A term from its N-Triples text."""
    got = parse_line(f"<x:s> <x:p> {text} .")
    if got is None or got[3]:
        raise SparqlError(f"not a term: {text!r}")
    return got[2]


def _row(t: Term):
    return {"k": t.k, "v": t.v, "dt": t.dt, "lang": t.lang, "dir": t.dir}


_TERM_ARROW = pa.struct([("k", pa.int8()), *((n, pa.string()) for n in ("v", "dt", "lang", "dir"))])
LINE_ARROW = pa.schema([("g", pa.string()), ("s", _TERM_ARROW), ("p", pa.string()), ("o", _TERM_ARROW), ("error", pa.string())])


def arrow_quads(rows: list[tuple]) -> pa.RecordBatch:
    """A batch of (s, p, o, g, error) rows."""
    return pa.RecordBatch.from_pylist([{"g": g, "s": s and _row(s), "p": p, "o": o and _row(o), "error": e} for s, p, o, g, e in rows], schema=LINE_ARROW)


def _cut(v: Column) -> Column:
    """The seven parts of a line without escapes or triple terms, by one match; other lines give another number."""
    iri, label = r"<[A-Za-z][A-Za-z0-9+.-]*:[^<>\"{}|^`\\\x00-\x20]*>", r"_:[^\s<>\"'@^(){},;.](?:[^\s<>\"'@^(){},;]*[^\s<>\"'@^(){},;.])?"
    pattern = rf"^\s*({iri}|{label})\s*({iri})\s*(?:({iri}|{label})|\"([^\"\\\r\n]*)\"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^({iri}))?)\s*({iri}|{label})?\s*\.\s*(?:#.*)?$"
    return F.split(F.regexp_replace(v, pattern, "\x01".join(f"${i}" for i in range(1, 8))), "\x01", -1)


def _native(c: Column) -> tuple[Column, Column, Column, Column]:
    """(s, p, o, g) of the parts of a plain line."""
    s, p, node, text, lang, dt, g = (F.get(c, i) for i in range(7))
    inner = lambda x: F.substr(x, F.lit(2), F.length(x) - 2)
    resource = lambda x: F.when(x.startswith("<"), R.make(1, inner(x))).otherwise(R.make(0, F.substr(x, F.lit(3))))
    literal = R.make(2, text, F.when(lang != "", R.LANG_STRING).when(dt != "", inner(dt)).otherwise(R.STRING), F.lower(lang))
    return resource(s), inner(p), F.when(node != "", resource(node)).otherwise(literal), F.when(g.startswith("<"), inner(g)).otherwise("")


def parse_lines(lines: DataFrame, mode: str = "PERMISSIVE", repair: Callable[[str, str], str | None] | None = None, flatten: bool = False) -> DataFrame:
    """Quads of a DataFrame of text lines (column value).

    mode PERMISSIVE keeps bad lines in an error column with null terms, DROPMALFORMED leaves them out, FAILFAST fails.
    repair(line, message) may give a line to try once instead. flatten puts all graphs into the default one.
    """
    cut = lines.select("value", _cut(F.col("value")).alias("parts"))
    plain = F.size("parts") == 7
    s, p, o, g = _native(F.col("parts"))
    easy = cut.where(plain).select(g.alias("g"), s.alias("s"), p.alias("p"), o.alias("o"), F.lit(None).cast("string").alias("error"))

    def run(batches):
        for b in batches:
            rows = []
            for line in b.column(0).to_pylist():
                try:
                    got = parse_line(line)
                except ValueError as e:
                    got, message = None, str(e)
                    if repair and (fixed := repair(line, message)) is not None:
                        try:
                            got, message = parse_line(fixed), None
                        except ValueError as e2:
                            message = str(e2)
                    if message:
                        if mode == "FAILFAST":
                            raise SparqlError(f"{message} in {line!r}") from None
                        rows.append((None, None, None, None, f"{message}: {line}"))
                        continue
                if got:
                    rows.append((*got, None))
            yield arrow_quads(rows)

    hard = cut.where(~plain).where(r"not value rlike '^\\s*(#.*)?$'").select("value").mapInArrow(run, LINE)
    out = easy.unionByName(hard)
    out = out.withColumn("g", F.when(F.col("s").isNotNull(), F.lit(""))) if flatten else out
    return out if mode == "PERMISSIVE" else out.where("error is null").drop("error")


def read_lines(spark: SparkSession, path: str, mode: str = "DROPMALFORMED", **options) -> DataFrame:
    """Quads of N-Triples or N-Quads files."""
    return parse_lines(spark.read.text(path), mode, **options)


def lines_of(quads: DataFrame, graphs: bool = True) -> DataFrame:
    """(value): a canonical line for each quad."""
    parts = [R.n3(F.col("s")), F.concat(F.lit("<"), F.col("p"), F.lit(">")), R.n3(F.col("o"))]
    if graphs and "g" in quads.columns:
        parts.append(F.when(F.col("g") != "", F.concat(F.lit("<"), F.col("g"), F.lit(">"))))
    return quads.select(F.concat(F.concat_ws(" ", *parts), F.lit(" .")).alias("value"))


def write_lines(quads: DataFrame, path: str, graphs: bool = True, ordered: bool = True, mode: str = "error") -> None:
    """N-Triples (graphs=False) or N-Quads files, each statement once; with ordered, sorted across files."""
    lines = lines_of(quads, graphs).distinct()
    (lines.orderBy("value") if ordered else lines).write.mode(mode).text(path)
