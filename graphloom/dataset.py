"""Datasets: mapped tables and quads behind one scan interface, immutable versions, graph access and set operations."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import terms as R
from .functions.values import as_term_rep
from .sources.mapping import COLUMN, PREFIX, TABLE, LazyTables, TableMap
from .terms import Namespaces, Term

GRAPH = "urn:g:"  # named graph of a mapped table: urn:g:<table>


def quads_frame(spark: SparkSession, quads: Iterable[tuple]) -> DataFrame:
    """A DataFrame of (s, p, o) or (s, p, o, g) tuples of Terms; p and g may be text."""
    row = lambda t: (t.k, t.v, t.dt, t.lang, t.dir)
    text = lambda x: x.v if isinstance(x, Term) else x or ""
    rows = [(text(q[3]) if len(q) > 3 else "", row(q[0]), text(q[1]), row(q[2])) for q in quads]
    return spark.createDataFrame(rows, R.QUADS)


class Dataset:
    """Quads (g, s, p, o) and mapped tables. Every change gives a new Dataset; the old one stays as it was."""

    def __init__(self, spark: SparkSession, quads: DataFrame | None = None, tables: dict[str, TableMap] | None = None, namespaces: Namespaces | None = None, graphs: Iterable[str] = (), loader=None):
        self.spark, self.quads, self.tables = spark, quads, tables if tables is not None else {}
        self.namespaces, self.graphs, self.loader = namespaces or Namespaces(R.PREFIXES), frozenset(graphs), loader
        self.from_, self.from_named = None, None

    @classmethod
    def of(cls, spark: SparkSession, quads: Iterable[tuple], **more) -> "Dataset":
        return cls(spark, quads_frame(spark, quads), **more)

    def with_quads(self, quads: DataFrame | None, graphs: Iterable[str] | None = None) -> "Dataset":
        return Dataset(self.spark, quads, self.tables, self.namespaces, self.graphs if graphs is None else graphs, self.loader)

    def restricted(self, default: list[str], named: list[str]) -> "Dataset":
        """The dataset that FROM and FROM NAMED describe."""
        if not default and not named:
            return self
        out = Dataset(self.spark, self.quads, self.tables, self.namespaces, self.graphs, self.loader)
        out.from_, out.from_named = default, named
        return out

    # scans
    def predicate_tables(self, predicate: str, graph: str = "") -> list[tuple[TableMap, str]]:
        """Mapped columns of a predicate. Tables whose columns share a prefix are looked at first, so that the others
        need not be opened."""
        names = self._tables_in(graph)
        first = [n for n in names if isinstance(self.tables, LazyTables) and n in PREFIX and predicate.startswith(COLUMN + PREFIX[n])]
        rest = [n for n in names if n not in first and not (isinstance(self.tables, LazyTables) and n in PREFIX)]
        for part in (first, rest):
            out = [(self.tables[n], self.tables[n].predicates()[predicate]) for n in part if predicate in self.tables[n].predicates()]
            if out:
                return out
        return []

    def _tables_in(self, graph: str) -> list[str]:
        if self.from_ is not None and graph == "":
            return [n for n in self.tables if GRAPH + n in self.from_]
        if graph == "":
            return list(self.tables)
        return [n for n in self.tables if GRAPH + n == graph and (self.from_named is None or graph in self.from_named)]

    def table_triples(self, name: str) -> DataFrame:
        """All triples of a mapped table, one scan."""
        table = self.tables[name]
        rep, subject = table.subject
        cells = [F.struct(F.lit(R.TYPE).alias("p"), R.const(Term(1, TABLE + name)).alias("o"))]
        for p, c in table.predicates().items():
            r, col = table.object(c)
            cells.append(F.struct(F.lit(p).alias("p"), as_term_rep(r, col).alias("o")))
        return table.df.select(as_term_rep(rep, subject).alias("s"), F.explode(F.array(*cells)).alias("c")).where("c.o is not null").select(F.lit(GRAPH + name).alias("g"), "s", "c.p", "c.o")

    def triples(self, graph: str | None = "", s: Term | None = None, p: str | None = None, o: Term | None = None) -> DataFrame:
        """(g, s, p, o) that match; None is a wildcard. graph: '' default, an IRI, None all named graphs."""
        parts = []
        if self.quads is not None:
            q = self.quads
            if graph == "" and self.from_ is not None:
                q = q.where(F.col("g").isin(*self.from_)) if self.from_ else q.limit(0)
                q = q.withColumn("g", F.lit("")).dropDuplicates(["s", "p", "o"])
            elif graph is None:
                q = q.where("g != ''")
                q = q if self.from_named is None else q.where(F.col("g").isin(*self.from_named) if self.from_named else F.lit(False))
            elif self.from_named is not None and graph and graph not in self.from_named:
                q = q.limit(0)
            else:
                q = q.where(F.col("g") == graph)
            parts.append(q.select("g", "s", "p", "o"))
        names = self._tables_in(graph) if graph is not None else [n for n in self.tables if self.from_named is None or GRAPH + n in self.from_named]
        for n in names:
            if p is not None and p != R.TYPE and (not p.startswith(COLUMN) or p not in self.tables[n].predicates()):
                continue
            t = self.table_triples(n)
            parts.append(t.withColumn("g", F.lit("")) if graph == "" else t)
        if not parts:
            return self.spark.createDataFrame([], R.QUADS)
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        if s is not None:
            out = out.where(F.col("s") == R.const(s))
        if p is not None:
            out = out.where(F.col("p") == p)
        if o is not None:
            out = out.where(F.col("o") == R.const(o))
        return out

    def graph_names(self) -> DataFrame:
        """(g) of the named graphs."""
        listed = [(GRAPH + n,) for n in self.tables] + [(g,) for g in self.graphs]
        out = self.spark.createDataFrame(listed, "g string")
        if self.quads is not None:
            out = out.union(self.quads.where("g != ''").select("g"))
        if self.from_named is not None:
            out = out.where(F.col("g").isin(*self.from_named) if self.from_named else F.lit(False))
        elif self.from_ is not None:
            out = out.limit(0)
        return out.distinct()

    # graph access
    def graph(self, name: str = "") -> "Graph":
        return Graph(self, name)

    def union_graph(self) -> DataFrame:
        """Triples of all graphs as one set."""
        every = self.triples("").unionByName(self.triples(None)) if self.quads is not None or self.tables else self.triples("")
        return every.select("s", "p", "o").distinct()

    # changes
    def add(self, quads: DataFrame | Iterable[tuple]) -> "Dataset":
        new = quads if isinstance(quads, DataFrame) else quads_frame(self.spark, quads)
        new = new.select("g", "s", "p", "o")
        return self.with_quads((new if self.quads is None else self.quads.unionByName(new)).distinct())

    def remove(self, quads: DataFrame | Iterable[tuple]) -> "Dataset":
        gone = quads if isinstance(quads, DataFrame) else quads_frame(self.spark, quads)
        if self.quads is None:
            return self
        return self.with_quads(self.quads.join(gone.distinct(), ["g", "s", "p", "o"], "left_anti").select("g", "s", "p", "o"))

    def remove_matching(self, s: Term | None = None, p: str | None = None, o: Term | None = None, g: str | None = "") -> "Dataset":
        test = F.lit(True)
        for col, x in (("s", s), ("o", o)):
            test = test & (F.col(col) == R.const(x)) if x is not None else test
        test = test & (F.col("p") == p) if p is not None else test
        test = test & (F.col("g") == g) if g is not None else test
        return self.with_quads(None if self.quads is None else self.quads.where(~test))

    def set(self, s: Term, p: str, o: Term, g: str = "") -> "Dataset":
        return self.remove_matching(s, p, None, g).add([(s, p, o, g)])

    def add_graph(self, name: str) -> "Dataset":
        """The dataset with a named graph registered, which may be empty."""
        return self.with_quads(self.quads, self.graphs | {name})

    def remove_graph(self, name: str) -> "Dataset":
        return self.with_quads(None if self.quads is None else self.quads.where(F.col("g") != name), self.graphs - {name})

    def checkpoint(self) -> "Dataset":
        """The same dataset over a written copy of its quads, with a short lineage."""
        from .operators.fixpoint import written

        return self if self.quads is None else self.with_quads(written(self.quads))


class Graph:
    """A view of one graph of a dataset: pattern access, set operations, lists."""

    def __init__(self, dataset: Dataset, name: str = ""):
        self.dataset, self.name = dataset, name

    def triples(self, s: Term | None = None, p: str | None = None, o: Term | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        out = self.dataset.triples(self.name, s, p, o).select("s", "p", "o")
        out = out.offset(offset) if offset else out
        return out if limit is None or limit <= 0 else out.limit(limit)

    def subjects(self, p=None, o=None) -> DataFrame:
        return self.triples(None, p, o).select("s").distinct()

    def predicates(self, s=None, o=None) -> DataFrame:
        return self.triples(s, None, o).select("p").distinct()

    def objects(self, s=None, p=None) -> DataFrame:
        return self.triples(s, p).select("o").distinct()

    def subject_predicates(self, o=None) -> DataFrame:
        return self.triples(None, None, o).select("s", "p").distinct()

    def subject_objects(self, p=None) -> DataFrame:
        return self.triples(None, p).select("s", "o").distinct()

    def predicate_objects(self, s=None) -> DataFrame:
        return self.triples(s).select("p", "o").distinct()

    def value(self, s=None, p=None, o=None) -> Term | None:
        """Any term at the one open place of a pattern."""
        free = [n for n, x in (("s", s), ("p", p), ("o", o)) if x is None]
        if len(free) != 1:
            raise ValueError("value() needs exactly two terms")
        row = self.triples(s, p, o).select(free[0]).first()
        return None if row is None else Term(1, row[0]) if free[0] == "p" else R.from_row(row[0])

    def contains(self, s=None, p=None, o=None) -> bool:
        return not self.triples(s, p, o).isEmpty()

    exists = contains

    def count(self, s=None, p=None, o=None) -> int:
        return self.triples(s, p, o).count()

    def __len__(self) -> int:
        return self.count()

    def all_nodes(self) -> DataFrame:
        t = self.triples()
        return t.select(F.col("s").alias("n")).union(t.select(F.col("o").alias("n"))).distinct()

    def union(self, other: "Graph") -> DataFrame:
        return self.triples().union(other.triples()).distinct()

    def intersection(self, other: "Graph") -> DataFrame:
        return self.triples().intersect(other.triples())

    def difference(self, other: "Graph") -> DataFrame:
        return self.triples().subtract(other.triples())

    def connected(self) -> bool:
        """Whether the graph hangs together when directions are ignored; an empty one does."""
        from .operators.fixpoint import components

        t = self.triples().select(F.to_json("s").alias("a"), F.to_json("o").alias("b"))
        return components(t).select("component").distinct().limit(2).count() < 2

    def items(self, head: Term) -> list[Term]:
        """Members of an RDF list; a cycle ends it."""
        out, seen = [], set()
        cells = {}
        for r in self.triples(None, R.FIRST).collect():
            cells.setdefault(R.from_row(r.s), [None, None])[0] = R.from_row(r.o)
        for r in self.triples(None, R.REST).collect():
            cells.setdefault(R.from_row(r.s), [None, None])[1] = R.from_row(r.o)
        while head in cells and head not in seen:
            seen.add(head)
            first, rest = cells[head]
            if first is not None:
                out.append(first)
            head = rest
        return out

    def resource(self, node: Term) -> "Resource":
        return Resource(self, node)

    def qname(self, value: str) -> str | None:
        return self.dataset.namespaces.qname(value, generate=True)


class Resource:
    """A node and what stands around it."""

    def __init__(self, graph: Graph, node: Term):
        self.graph, self.node = graph, node

    def objects(self, p: str) -> DataFrame:
        return self.graph.objects(self.node, p)

    def subjects(self, p: str) -> DataFrame:
        return self.graph.subjects(p, self.node)

    def value(self, p: str) -> Term | None:
        return self.graph.value(self.node, p)

    def add(self, p: str, o: Term) -> "Resource":
        return Resource(Graph(self.graph.dataset.add([(self.node, p, o, self.graph.name)]), self.graph.name), self.node)

    def remove(self, p: str, o: Term | None = None) -> "Resource":
        return Resource(Graph(self.graph.dataset.remove_matching(self.node, p, o, self.graph.name), self.graph.name), self.node)

    def set(self, p: str, o: Term) -> "Resource":
        return Resource(Graph(self.graph.dataset.set(self.node, p, o, self.graph.name), self.graph.name), self.node)


class Collection:
    """An RDF list in a graph; a change gives a new Collection over a new dataset."""

    def __init__(self, graph: Graph, head: Term):
        self.graph, self.head = graph, head
        self.members = graph.items(head)

    def __len__(self) -> int:
        return len(self.members)

    def __getitem__(self, i: int) -> Term:
        return self.members[i]

    def __iter__(self):
        return iter(self.members)

    def index(self, item: Term) -> int:
        return self.members.index(item)

    def _cells(self) -> list[Term]:
        rest = {R.from_row(r.s): R.from_row(r.o) for r in self.graph.triples(None, R.REST).collect()}
        out, at = [], self.head
        while at in rest and at not in out:
            out.append(at)
            at = rest[at]
        return out

    def append(self, item: Term) -> "Collection":
        name, ds = self.graph.name, self.graph.dataset
        new, quads = list_quads([item], name)
        cells = self._cells()
        if cells:
            ds = ds.set(cells[-1], R.REST, new, name).add(quads)
            return Collection(Graph(ds, name), self.head)
        return Collection(Graph(ds.add(quads), name), new)

    def clear(self) -> "Collection":
        """The empty list; the cells go."""
        name, ds = self.graph.name, self.graph.dataset
        for c in self._cells():
            ds = ds.remove_matching(c, R.FIRST, None, name).remove_matching(c, R.REST, None, name)
        return Collection(Graph(ds, name), Term(1, R.NIL))


def list_quads(items: list[Term], g: str = "") -> tuple[Term, list[tuple]]:
    """(head, quads) of a new RDF list."""
    if not items:
        return Term(1, R.NIL), []
    cells = [R.bnode() for _ in items]
    out = []
    for i, (c, x) in enumerate(zip(cells, items, strict=True)):
        out += [(c, R.FIRST, x, g), (c, R.REST, cells[i + 1] if i + 1 < len(cells) else Term(1, R.NIL), g)]
    return cells[0], out


def isomorphic(a: Iterable[tuple], b: Iterable[tuple]) -> bool:
    """Whether two small graphs (tuples of Terms and predicate text) differ only in blank node labels: labels are refined
    by their neighbourhoods, ties are tried out."""
    a, b = sorted(set(a), key=repr), sorted(set(b), key=repr)
    if len(a) != len(b):
        return False

    def refined(quads, colour):
        for _ in range(len(colour) + 1):
            new = {}
            for n in colour:
                show = lambda t, n=n: ("*" if t == n else colour[t]) if isinstance(t, Term) and t in colour else t.n3 if isinstance(t, Term) else t
                new[n] = hash(tuple(sorted(repr([show(x) for x in q]) for q in quads if n in q)))
            if len(set(new.values())) == len(set(colour.values())):
                return new
            colour = new
        return colour

    def nodes(quads):
        return {t: 0 for q in quads for t in q if isinstance(t, Term) and t.k == 0}

    def fits(ca, cb, depth):
        ca, cb = refined(a, ca), refined(b, cb)
        if sorted(ca.values()) != sorted(cb.values()):
            return False
        if len(set(ca.values())) == len(ca):
            other = {c: n for n, c in cb.items()}
            swap = lambda t: other[ca[t]] if isinstance(t, Term) and t in ca else t
            return {tuple(swap(x) for x in q) for q in a} == set(b)
        counts = {}
        for c in ca.values():
            counts[c] = counts.get(c, 0) + 1
        n = min((x for x in ca if counts[ca[x]] > 1), key=repr)
        return any(fits(ca | {n: ("fixed", depth)}, cb | {m: ("fixed", depth)}, depth + 1) for m in cb if cb[m] == ca[n])

    return fits(nodes(a), nodes(b), 0)
