"""The SPARQL protocol over HTTP: /query and /update on a dataset; driver-side only."""

from __future__ import annotations

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .dataset import Dataset
from .engine import query
from .operators.update import update
from .plans.parser import SparqlError, parse_query
from .sources import registry, results

MOST_BYTES = 10 * 1024 * 1024
#: Media types of results.
RESULTS = {"application/sparql-results+json": "json", "application/json": "json", "application/sparql-results+xml": "xml", "application/xml": "xml", "text/csv": "csv", "text/tab-separated-values": "tsv"}
GRAPHS = {"text/turtle": "turtle", "application/n-triples": "nt", "application/rdf+xml": "xml", "application/ld+json": "json-ld"}


class Endpoint:
    def __init__(self, ds: Dataset, writable: bool = True):
        self.ds, self.writable, self.lock = ds, writable, threading.Lock()

    def respond(self, method: str, target: str, headers, body: bytes) -> tuple[int, str, bytes]:
        """(status, content type, body)."""
        parts = urlsplit(target)
        given = parse_qs(parts.query)
        kind = (headers.get("Content-Type") or "").partition(";")[0].strip().lower()
        if len(body) > MOST_BYTES:
            return 413, "text/plain", b"request too large"
        if method == "POST":
            if kind == "application/x-www-form-urlencoded":
                for k, v in parse_qs(body.decode()).items():
                    given.setdefault(k, []).extend(v)
            elif kind in ("application/sparql-query", "application/sparql-update"):
                given[kind.removeprefix("application/sparql-")] = [body.decode()]
            else:
                return 415, "text/plain", b"unsupported media type"
        elif method != "GET":
            return 405, "text/plain", b"method not allowed"
        try:
            if parts.path.rstrip("/").endswith("/update"):
                return self._update(method, given)
            if parts.path.rstrip("/").endswith("/query"):
                return self._query(given, headers.get("Accept") or "*/*")
            return 404, "text/plain", b"not found"
        except SparqlError as e:
            return 400, "text/plain", str(e).encode()

    def _update(self, method, given):
        if method != "POST":
            return 405, "text/plain", b"updates are POST requests"
        if not self.writable:
            return 403, "text/plain", b"read-only"
        if len(given.get("update", [])) != 1:
            return 400, "text/plain", b"one update is needed"
        with self.lock:
            self.ds = update(self.ds, given["update"][0], checkpoint=True)
        return 204, "text/plain", b""

    def _query(self, given, accept: str):
        if len(given.get("query", [])) != 1:
            return 400, "text/plain", b"one query is needed"
        text = given["query"][0]
        form = parse_query(text, "", tuple(sorted(self.ds.namespaces.by.items()))).form
        default, named = given.get("default-graph-uri", []), given.get("named-graph-uri", [])
        ds = self.ds.restricted(default, named) if default or named else self.ds
        wanted = [a.partition(";")[0].strip().lower() for a in accept.split(",")]
        table = GRAPHS if form == "CONSTRUCT" else RESULTS
        kind = next((w for w in wanted if w in table), None)
        if kind is None:
            if not any(w in ("*/*", "", "application/*", "text/*") for w in wanted):
                return 406, "text/plain", b"no acceptable format"
            kind = "text/turtle" if form == "CONSTRUCT" else "application/sparql-results+json"
        df = query(ds, text)
        name = table[kind]
        if form == "CONSTRUCT":
            out = registry.serialize(df, name, self.ds.namespaces)
        elif form == "ASK":
            out = results.boolean_xml(df.first()[0]) if name == "xml" else results.boolean_json(df.first()[0])
        else:
            out = {"json": results.to_json, "xml": results.to_xml, "csv": results.to_csv, "tsv": results.to_tsv}[name](*results.rows_of(df))
        return 200, kind, out.encode()


def serve(endpoint: Endpoint, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A running server; its port is server_address[1], shutdown() ends it."""

    class Handler(BaseHTTPRequestHandler):
        def _any(self):
            n = int(self.headers.get("Content-Length") or 0)
            body = self.rfile.read(min(n, MOST_BYTES + 1))
            status, kind, out = endpoint.respond(self.command, self.path, self.headers, body)
            self.send_response(status)
            self.send_header("Content-Type", kind + "; charset=utf-8")
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_POST = do_PUT = do_DELETE = _any

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
