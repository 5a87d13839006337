"""Formats by name, file name, media type and content; reading and writing through one door."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as R
from ..terms import Namespaces, Term
from . import jsonld, ntriples, rdfxml, turtle

Quads = list[tuple[Term, str, Term, str]]


def _lines(text: str, base: str = "", scope: str = "") -> Quads:
    return [q for q in map(ntriples.parse_line, text.splitlines()) if q]


PARSERS: dict[str, Callable[..., Quads]] = {
    "nt": _lines, "nquads": _lines, "turtle": turtle.parse_turtle, "trig": turtle.parse_trig, "xml": rdfxml.parse_rdfxml, "json-ld": jsonld.parse_jsonld,
}
SERIALIZERS: dict[str, Callable[..., str]] = {
    "nt": lambda q, ns=None: "".join(sorted(f"{s.n3} <{p}> {o.n3} .\n" for s, p, o, _ in set(q))),
    "nquads": lambda q, ns=None: "".join(sorted(f"{s.n3} <{p}> {o.n3}{f' <{g}>' if g and not g.startswith('_:') else ''} .\n" for s, p, o, g in set(q))),
    "turtle": lambda q, ns=None: turtle.turtle_text([x[:3] for x in q], ns),
    "trig": lambda q, ns=None: turtle.trig_text(q, ns),
    "xml": lambda q, ns=None: rdfxml.rdfxml_text([x[:3] for x in q], ns),
    "json-ld": lambda q, ns=None: jsonld.jsonld_text(q, ns),
}
STORES: dict[str, Callable] = {}
#: File endings and media types.
ENDINGS = {"nt": "nt", "nq": "nquads", "nquads": "nquads", "ttl": "turtle", "turtle": "turtle", "trig": "trig", "rdf": "xml", "xml": "xml", "owl": "xml", "rdfs": "xml", "jsonld": "json-ld", "json": "json-ld", "n3": "turtle"}
MEDIA = {
    "application/n-triples": "nt", "text/plain": "nt", "application/n-quads": "nquads", "text/turtle": "turtle", "application/x-turtle": "turtle", "text/n3": "turtle",
    "application/trig": "trig", "application/rdf+xml": "xml", "application/xml": "xml", "text/xml": "xml", "application/ld+json": "json-ld", "application/json": "json-ld",
}


def register_parser(name: str, f: Callable) -> None:
    PARSERS[name] = f


def register_serializer(name: str, f: Callable) -> None:
    SERIALIZERS[name] = f


def register_store(name: str, f: Callable) -> None:
    STORES[name] = f


def format_of_name(path: str) -> str | None:
    return ENDINGS.get(re.sub(r"\.(gz|bz2|zst)$", "", path.lower()).rpartition(".")[2])


def format_of_media(media: str) -> str | None:
    return MEDIA.get(media.partition(";")[0].strip().lower())


def format_of_content(text: str) -> str | None:
    head = text[:500].lstrip("﻿ \t\r\n")
    if head.startswith(("<?xml", "<rdf:RDF", "<RDF")) or "<rdf:RDF" in head:
        return "xml"
    if head.startswith(("{", "[")) and re.search(r'"@?(context|id|graph|type)"', head):
        return "json-ld"
    if re.search(r"^\s*(@prefix|@base|PREFIX\s|BASE\s)", head, re.M | re.I):
        return "trig" if re.search(r"(^|\s)(GRAPH\s+)?(<[^>]*>|[\w-]*:[\w-]*)?\s*\{", head) else "turtle"
    line = next((x for x in head.splitlines() if x.strip() and not x.lstrip().startswith("#")), "")
    try:
        got = ntriples.parse_line(line)
    except ValueError:
        return "turtle" if re.match(r"(<[^<>\s]*>|_:\S+)\s", line) else None
    return None if got is None else "nquads" if got[3] else "nt"


def read(spark: SparkSession, path: str, format: str | None = None, base: str = "", mode: str = "DROPMALFORMED") -> DataFrame:
    """Quads of files. Line formats split into tasks; the others are parsed a file a task."""
    format = format or format_of_name(path)
    if format is None:
        format = format_of_content("\n".join(r.value for r in spark.read.text(path).limit(50).collect()))
    if format in ("nt", "nquads"):
        return ntriples.read_lines(spark, path, mode)
    if format not in PARSERS:
        raise ValueError(f"unknown format of {path}")
    parse = PARSERS[format]

    def run(batches):
        for b in batches:
            for where, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    quads = parse(content.decode("utf-8-sig"), base=base or where, scope=turtle.scope_of(where))
                except ValueError:
                    if mode == "FAILFAST" or mode == "DROPMALFORMED":
                        raise
                    quads = []
                for at in range(0, len(quads), 5000):
                    yield ntriples.arrow_quads([(*q, None) for q in quads[at : at + 5000]])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ntriples.LINE).drop("error")


def parse(text: str, format: str, base: str = "", scope: str = "") -> Quads:
    return PARSERS[format](text, base=base, scope=scope)


def load(ds, uri: str, graph: str = ""):
    """A dataset with the contents of a file or URI that Spark can open, all in one graph."""
    if uri.startswith(("http://", "https://")):
        import urllib.request

        with urllib.request.urlopen(uri, timeout=30) as r:
            format = format_of_media(r.headers.get("Content-Type", "")) or format_of_name(uri) or "turtle"
            from ..dataset import quads_frame

            q = quads_frame(ds.spark, parse(r.read().decode(), format, base=uri, scope=turtle.scope_of(uri)))
    else:
        q = read(ds.spark, uri, base=uri if ":" in uri else "")
    return ds.add(q.withColumn("g", F.lit(graph)))


def collected(quads: DataFrame) -> Quads:
    g = "g" in quads.columns
    return [(R.from_row(r.s), r.p, R.from_row(r.o), r.g if g else "") for r in quads.collect()]


def serialize(quads: DataFrame, format: str, namespaces: Namespaces | None = None) -> str:
    """A graph that fits the driver as one document."""
    return SERIALIZERS[format](collected(quads), namespaces)


def write(quads: DataFrame, path: str, format: str = "nquads", namespaces: Namespaces | None = None, mode: str = "error") -> None:
    """Files of any size. Line formats are written line by line; Turtle a block per subject, in parts sorted by subject."""
    if format in ("nt", "nquads"):
        ntriples.write_lines(quads, path, graphs=format == "nquads", mode=mode)
        return
    if format == "turtle":
        ns = dict((namespaces or Namespaces(R.PREFIXES)).by)

        def run(batches):
            import itertools

            rows = (r for b in batches for r in b.to_pylist())
            for s, group in itertools.groupby(rows, key=lambda r: r["s"]):
                w = turtle.TurtleWriter([(R.from_row(s), r["p"], R.from_row(r["o"])) for r in group], Namespaces(ns))
                w.uses = {k: 2 for k in w.uses} | {R.from_row(s): 2}  # labels stay: other parts may use them
                yield pa.RecordBatch.from_pydict({"value": [w.header().replace("\n\n", "\n") + w.block()]})

        ordered = quads.select("s", "p", "o").distinct().repartitionByRange("s").sortWithinPartitions("s", "p")
        ordered.mapInArrow(run, "value string").write.mode(mode).text(path)
        return
    text = serialize(quads, format, namespaces)
    quads.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(path)
