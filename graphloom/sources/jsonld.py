"""JSON-LD: inline contexts, node objects, lists, sets, graphs, reverse properties; reading and writing."""

from __future__ import annotations

import json
import re

from .. import terms as R
from ..plans.parser import SparqlError
from ..terms import Namespaces, Term
from .turtle import fresh_prefix

_KEYWORDS = {"@context", "@id", "@type", "@value", "@language", "@direction", "@graph", "@list", "@set", "@reverse", "@index", "@none", "@nest", "@included", "@json"}


class Context:
    def __init__(self, base: str = ""):
        self.base, self.vocab, self.lang, self.dir, self.terms = base, "", "", "", {}

    def extended(self, c, remote) -> "Context":
        out = Context(self.base)
        out.vocab, out.lang, out.dir, out.terms = self.vocab, self.lang, self.dir, dict(self.terms)
        for part in c if isinstance(c, list) else [c]:
            if part is None:
                out = Context(out.base)
                continue
            if isinstance(part, str):
                if remote is None:
                    raise SparqlError(f"remote context {part} can't be loaded")
                loaded = remote(part)
                out = out.extended(loaded.get("@context", loaded), remote)
                continue
            if "@base" in part:
                out.base = R.resolve(out.base, part["@base"]) if part["@base"] else ""
            if "@vocab" in part:
                out.vocab = part["@vocab"] or ""
            out.lang = (part["@language"] or "") if "@language" in part else out.lang
            out.dir = (part["@direction"] or "") if "@direction" in part else out.dir
            for name in part:
                if not name.startswith("@"):
                    out.define(name, part[name], part)
        return out

    def define(self, name: str, d, local) -> None:
        if d is None:
            self.terms[name] = None
            return
        d = {"@id": d} if isinstance(d, str) else dict(d)
        reverse = "@reverse" in d
        target = d.get("@reverse") if reverse else d.get("@id", name if ":" in name else None)
        full = self.iri(target, local, name) if target is not None else (self.vocab + name if self.vocab else None)
        self.terms[name] = {"id": full, "type": d.get("@type"), "container": d.get("@container"), "lang": d.get("@language", None), "has_lang": "@language" in d, "dir": d.get("@direction"), "reverse": reverse, "context": d.get("@context")}
        t = d.get("@type")
        if t and not t.startswith("@"):
            self.terms[name]["type"] = self.iri(t, local, name)

    def iri(self, v: str, local=None, skip=None) -> str:
        """A vocabulary IRI."""
        if v.startswith("@"):
            return v
        if v != skip and v in self.terms and self.terms[v]:
            return self.terms[v]["id"] or v
        if local and v != skip and v in local and not v.startswith("@"):
            self.define(v, local[v], local)
            return self.terms[v]["id"] if self.terms[v] else v
        prefix, sep, rest = v.partition(":")
        if sep:
            if prefix == "_" or rest.startswith("//"):
                return v
            if local and prefix in local and prefix not in self.terms and prefix != skip:
                self.define(prefix, local[prefix], local)
            if prefix in self.terms and self.terms[prefix] and self.terms[prefix]["id"]:
                return self.terms[prefix]["id"] + rest
            return v
        return self.vocab + v if self.vocab else v

    def node(self, v: str) -> str:
        """A document-relative IRI."""
        prefix, sep, rest = v.partition(":")
        if sep and prefix in self.terms and self.terms[prefix] and not rest.startswith("//"):
            return self.iri(v)
        return v if v.startswith("_:") else R.resolve(self.base, v)


class JsonLdParser:
    def __init__(self, base: str = "", scope: str = "", loader=None):
        self.base, self.scope, self.loader, self.fresh, self.out = base, scope, loader, 0, []

    def blank(self, label=None) -> Term:
        if label is not None:
            return Term(0, self.scope + label)
        self.fresh += 1
        return Term(0, f"{self.scope}{self.gen}{self.fresh}")

    def parse(self, text) -> list[tuple[Term, str, Term, str]]:
        self.gen = fresh_prefix(text)
        try:
            data = json.loads(text)
        except ValueError as e:
            raise SparqlError(f"not JSON: {e}") from None
        for x in data if isinstance(data, list) else [data]:
            self.value(x, Context(self.base), "", None, top=True)
        return self.out

    def resource(self, v: str, ctx: Context) -> Term | None:
        v = ctx.node(v)
        if v.startswith("_:"):
            return self.blank(v[2:])
        return Term(1, v) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", v) and not re.search(r'[\s<>"{}|^`\\]', v) else None

    def node(self, x: dict, ctx: Context, g: str, top: bool = False) -> Term | None:
        if "@context" in x:
            ctx = ctx.extended(x["@context"], self.loader)
        keys = {k: ctx.iri(k) if not k.startswith("@") else k for k in x}
        for k, d in list(ctx.terms.items()):
            if d and d["id"] in _KEYWORDS and k in x:
                keys[k] = d["id"]
        by = {}
        for k, full in keys.items():
            by.setdefault(full, []).append(k)
        types = [t for k in by.get("@type", []) for t in _many(x[k])]
        for t in sorted(types):
            d = ctx.terms.get(t)
            if d and d.get("context") is not None:
                ctx = ctx.extended(d["context"], self.loader)
        ids = [x[k] for k in by.get("@id", [])]
        s = self.resource(ids[0], ctx) if ids and isinstance(ids[0], str) else None
        only_graph = top and set(keys.values()) <= {"@context", "@graph"}
        if s is None:
            if ids and not (isinstance(ids[0], str) and False):
                if ids[0] is not None and ids:
                    s = None
            s = s or (None if only_graph else self.blank())
        for t in types:
            full = ctx.iri(t)
            o = self.blank(full[2:]) if full.startswith("_:") else Term(1, full if ":" in full else R.resolve(ctx.base, full))
            self.out.append((s, R.TYPE, o, g))
        for k, full in keys.items():
            v = x[k]
            if full == "@graph":
                inner = g if only_graph else (s.v if s.k == 1 else "_:" + s.v)
                for y in _many(v):
                    self.value(y, ctx, inner, None)
            elif full == "@reverse":
                for p, ys in v.items():
                    for y in _many(ys):
                        o = self.value(y, ctx, g, None)
                        if o is not None:
                            self.out.append((o, ctx.iri(p), s, g))
            elif full == "@included":
                for y in _many(v):
                    self.value(y, ctx, g, None)
            elif full.startswith("@") or ":" not in full or full.startswith("_:"):
                continue
            else:
                d = ctx.terms.get(k) or {}
                inner = ctx.extended(d["context"], self.loader) if d.get("context") is not None else ctx
                self.property(s, full, v, inner, g, d)
        return s

    def property(self, s: Term, p: str, v, ctx: Context, g: str, d: dict) -> None:
        box = _many(d.get("container") or [])
        if v is None:
            return
        if "@language" in box and isinstance(v, dict):
            for lang, texts in sorted(v.items()):
                for t in _many(texts):
                    if t is not None:
                        self.emit(s, p, R.literal(t, lang="" if lang == "@none" else lang, dir=d.get("dir") or ""), g, d)
            return
        if ("@index" in box or "@id" in box or "@type" in box) and isinstance(v, dict):
            for key, ys in sorted(v.items()):
                for y in _many(ys):
                    if "@id" in box and isinstance(y, dict) and key != "@none":
                        y = {"@id": key, **y}
                    if "@type" in box and isinstance(y, dict) and key != "@none":
                        y = {**y, "@type": [key, *_many(y.get("@type", []))]}
                    self.emit(s, p, self.value(y, ctx, g, d), g, d)
            return
        if "@list" in box and not (isinstance(v, dict) and "@list" in v):
            v = {"@list": v}
        if d.get("type") == "@json":
            self.emit(s, p, Term(2, json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True), R.RDF + "JSON"), g, d)
            return
        for y in _many(v):
            if isinstance(y, list):
                y = {"@set": y}
            if isinstance(y, dict) and "@set" in y:
                for z in _many(y["@set"]):
                    self.emit(s, p, self.value(z, ctx, g, d), g, d)
                continue
            self.emit(s, p, self.value(y, ctx, g, d), g, d)

    def emit(self, s, p, o, g, d) -> None:
        if s is None or o is None:
            return
        if d.get("reverse"):
            if o.k != 2:
                self.out.append((o, p, s, g))
            return
        self.out.append((s, p, o, g))

    def value(self, x, ctx: Context, g: str, d: dict | None, top: bool = False) -> Term | None:
        d = d or {}
        if x is None:
            return None
        if isinstance(x, dict):
            local = ctx.extended(x["@context"], self.loader) if "@context" in x and ("@value" in x or "@list" in x) else ctx
            if "@value" in x:
                v, t = x["@value"], x.get("@type")
                if v is None:
                    return None
                if t == "@json":
                    return Term(2, json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True), R.RDF + "JSON")
                if x.get("@language") or x.get("@direction"):
                    return R.literal(v, lang=x.get("@language") or "", dir=x.get("@direction") or "") if x.get("@language") else Term(2, str(v), R.STRING)
                return _plain(v, local.iri(t) if t else None)
            if "@list" in x:
                items = [i for i in (self.value(y if not isinstance(y, list) else {"@list": y}, local, g, {**d, "container": None}) for y in _many(x["@list"])) if i is not None]
                cells = [self.blank() for _ in items]
                for i, (c, item) in enumerate(zip(cells, items, strict=True)):
                    self.out.append((c, R.FIRST, item, g))
                    self.out.append((c, R.REST, cells[i + 1] if i + 1 < len(cells) else Term(1, R.NIL), g))
                return cells[0] if cells else Term(1, R.NIL)
            return self.node(x, ctx, g, top)
        if top or not d and not isinstance(x, (str, int, float, bool)):
            return None
        t = d.get("type")
        if t == "@id" and isinstance(x, str):
            return self.resource(x, ctx)
        if t == "@vocab" and isinstance(x, str):
            full = ctx.iri(x)
            return Term(1, full if ":" in full else R.resolve(ctx.base, full))
        if t and not t.startswith("@"):
            return _plain(x, t)
        if isinstance(x, str):
            lang = d["lang"] if d.get("has_lang") else ctx.lang
            return R.literal(x, lang=lang or "", dir=d.get("dir") or ctx.dir)
        return _plain(x, None)


def _many(x) -> list:
    return x if isinstance(x, list) else [x]


def _plain(v, t: str | None) -> Term:
    if isinstance(v, bool):
        return Term(2, "true" if v else "false", t or R.BOOLEAN)
    if isinstance(v, (int, float)):
        if isinstance(v, int) and t != R.DOUBLE or isinstance(v, float) and v == int(v) and abs(v) < 1e21 and t != R.DOUBLE:
            return Term(2, str(int(v)), t or R.INTEGER)
        mantissa, _, exponent = f"{float(v):.15E}".partition("E")
        mantissa = mantissa.rstrip("0")
        return Term(2, (mantissa + "0" if mantissa.endswith(".") else mantissa) + "E" + str(int(exponent)), t or R.DOUBLE)
    return Term(2, str(v), t or R.STRING)


def parse_jsonld(text, base: str = "", scope: str = "", loader=None) -> list[tuple[Term, str, Term, str]]:
    return JsonLdParser(base, scope, loader).parse(text)


def jsonld_text(quads, namespaces: Namespaces | None = None, expanded: bool = False, native: bool = False) -> str:
    """Node objects by subject, named graphs as nodes with @graph; compacted with the prefixes in use unless expanded."""
    ns, used = namespaces or Namespaces(R.PREFIXES), {}

    def name(v: str) -> str:
        if expanded:
            return v
        q = ns.qname(v)
        if q is None:
            return v
        used[q.partition(":")[0]] = ns.by[q.partition(":")[0]]
        return q

    by: dict[str, list] = {}
    for s, p, o, g in dict.fromkeys(quads):
        by.setdefault(g, []).append((s, p, o))

    def graph(triples):
        subjects: dict[Term, dict[str, list[Term]]] = {}
        uses: dict[Term, int] = {}
        for s, p, o in triples:
            subjects.setdefault(s, {}).setdefault(p, []).append(o)
            uses[o] = uses.get(o, 0) + 1
        cells: set[Term] = set()

        def members(head):
            items, seen = [], []
            while head != Term(1, R.NIL):
                c = subjects.get(head)
                if c is None or head.k or set(c) != {R.FIRST, R.REST} or len(c[R.FIRST]) != 1 or len(c[R.REST]) != 1 or uses.get(head) != 1 or head in seen:
                    return None
                seen.append(head)
                items.append(c[R.FIRST][0])
                head = c[R.REST][0]
            return items, seen

        def node_id(t):
            return "_:" + t.v if t.k == 0 else name(t.v)

        def value(t):
            if t.k in (0, 1):
                got = members(t) if t.k == 0 or t.v == R.NIL else None
                if got is not None:
                    cells.update(got[1])
                    return {"@list": [value(x) for x in got[0]]}
                return {"@id": node_id(t)}
            if t.k == 3:
                raise ValueError("JSON-LD has no triple terms")
            if t.lang:
                return {"@value": t.v, "@language": t.lang} | ({"@direction": t.dir} if t.dir else {})
            if t.dt in ("", R.STRING):
                return {"@value": t.v} if expanded else t.v
            return {"@value": t.v, "@type": name(t.dt)}

        nodes = []
        for s in sorted(subjects):
            out = {"@id": node_id(s)}
            for p, os in sorted(subjects[s].items()):
                if p == R.TYPE and all(o.k in (0, 1) for o in os):
                    out["@type"] = [node_id(o) for o in sorted(os)]
                    continue
                vs = [value(o) for o in sorted(os)]
                out[name(p)] = vs if expanded or len(vs) > 1 else vs[0]
            nodes.append((s, out))
        return [n for s, n in nodes if s not in cells]

    nodes = graph(by.pop("", []))
    for g in sorted(by):
        nodes.append({"@id": g if g.startswith("_:") else name(g), "@graph": graph(by[g])})
    if expanded:
        return json.dumps(nodes, ensure_ascii=False, indent=2)
    return json.dumps(({"@context": dict(sorted(used.items()))} if used else {}) | {"@graph": nodes}, ensure_ascii=False, indent=2)
