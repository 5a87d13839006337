"""Quads at rest: versions of Parquet files split by predicate and sorted by subject, with a pointer to the current one;
and datasets behind a SPARQL endpoint."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as R
from ..dataset import Dataset
from ..terms import Namespaces, Term
from . import results


class ParquetStore:
    """save() writes a whole new version beside the old ones and then moves the pointer, so readers never see half of
    one. Quads lie there twice: by buckets of predicate and subject, and by buckets of object. The buckets are partition
    columns, so a scan for a predicate, a subject or an object opens its buckets only, and files are sorted inside."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, read_only: bool = False):
        self.spark, self.path, self.buckets, self.read_only = spark, path.rstrip("/"), buckets, read_only

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The current version, 0 when there is none."""
        p, fs = self._fs(f"{self.path}/current")
        if not fs.exists(p):
            return 0
        return json.loads(self.spark.read.text(f"{self.path}/current").first()[0])["version"]

    def _pointer(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/current").first()[0])

    def save(self, ds: Dataset) -> int:
        if self.read_only:
            raise PermissionError("the store is read-only")
        n = self.version() + 1
        quads = ds.quads if ds.quads is not None else self.spark.createDataFrame([], R.QUADS)
        rows = quads.select("g", "s", "p", "o").distinct()
        # a hot predicate or object is one bucket but many tasks: the subject's hash spreads it
        by = rows.withColumn("b", _bucket(F.col("p"), self.buckets)).withColumn("sb", _bucket(F.col("s.v"), SUBJECTS))
        by.repartition("b", "sb").sortWithinPartitions("b", "sb", "p", "s.v", "o.v").write.partitionBy("b", "sb").parquet(f"{self.path}/v{n}")
        by = rows.withColumn("ob", _bucket(F.col("o.v"), self.buckets))
        by.repartition("ob", _bucket(F.col("s.v"), SUBJECTS)).sortWithinPartitions("ob", "o.v", "s.v").write.partitionBy("ob").parquet(f"{self.path}/v{n}-objects")
        pointer = json.dumps({"version": n, "buckets": self.buckets, "namespaces": ds.namespaces.by, "graphs": sorted(ds.graphs)})
        tmp, fs = self._fs(f"{self.path}/next-{n}")
        stream = fs.create(tmp, True)
        stream.write(bytearray(pointer.encode()))
        stream.close()
        current, _ = self._fs(f"{self.path}/current")
        fs.delete(current, False)
        fs.rename(tmp, current)
        return n

    def load(self, version: int | None = None) -> Dataset:
        pointer = self._pointer()
        at, cells = f"{self.path}/v{version or pointer['version']}", f"g string, s {R.TERM_DDL}, p string, o {R.TERM_DDL}"
        by_subject = self.spark.read.schema(f"{cells}, b int, sb int").parquet(at)
        return StoredDataset(self.spark, by_subject, self.spark.read.schema(f"{cells}, ob int").parquet(f"{at}-objects"), pointer["buckets"], Namespaces(pointer["namespaces"]), pointer["graphs"])


#: Buckets of subjects inside a bucket of predicates.
SUBJECTS = 8


def _bucket(c: Column, n: int) -> Column:
    """A bucket by hash; of a literal it folds to a constant that prunes partitions."""
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


class StoredDataset(Dataset):
    """Scans for a predicate, a subject or an object prune to its buckets."""

    def __init__(self, spark, by_subject: DataFrame, by_object: DataFrame, buckets: int, namespaces, graphs):
        super().__init__(spark, by_subject.drop("b", "sb"), namespaces=namespaces, graphs=graphs)
        self.by_subject, self.by_object, self.buckets = by_subject, by_object, buckets

    def triples(self, graph="", s=None, p=None, o=None) -> DataFrame:
        if p is None and s is None and o is None:
            return super().triples(graph, s, p, o)
        if p is None and s is None:
            rows = self.by_object.where(F.col("ob") == _bucket(F.lit(o.v), self.buckets)).drop("ob")
        else:
            rows = self.by_subject
            if p is not None:
                rows = rows.where(F.col("b") == _bucket(F.lit(p), self.buckets))
            if s is not None:
                rows = rows.where(F.col("sb") == _bucket(F.lit(s.v), SUBJECTS))
            rows = rows.drop("b", "sb")
        narrow = Dataset(self.spark, rows)
        narrow.from_, narrow.from_named = self.from_, self.from_named
        return narrow.triples(graph, s, p, o)


class RemoteStore:
    """A dataset behind a SPARQL endpoint: patterns become queries, changes become updates."""

    def __init__(self, spark: SparkSession, query_url: str, update_url: str | None = None, timeout: float = 30, opener=None):
        self.spark, self.query_url, self.update_url, self.timeout = spark, query_url, update_url, timeout
        self.open = opener or urllib.request.urlopen

    def _post(self, url: str, body: str, kind: str, accept: str) -> str:
        r = urllib.request.Request(url, data=body.encode(), headers={"Content-Type": kind, "Accept": accept})
        with self.open(r, timeout=self.timeout) as got:
            return got.read().decode()

    def query(self, text: str):
        """A DataFrame of solutions, or a truth value."""
        got = results.from_json(self._post(self.query_url, text, "application/sparql-query", "application/sparql-results+json"))
        return got if isinstance(got, bool) else results.frame_of(self.spark, *got)

    def update(self, text: str) -> None:
        if self.update_url is None:
            raise PermissionError("the store is read-only")
        self._post(self.update_url, text, "application/sparql-update", "*/*")

    def _pattern(self, s, p, o, g) -> tuple[str, list[str]]:
        given = {"s": s, "p": Term(1, p) if isinstance(p, str) else p, "o": o}
        text = " ".join(t.n3 if t is not None else f"?{n}" for n, t in given.items())
        return (f"GRAPH <{g}> {{ {text} }}" if g else text), [n for n, t in given.items() if t is None]

    def triples(self, s: Term | None = None, p: str | None = None, o: Term | None = None, g: str = "") -> DataFrame:
        text, free = self._pattern(s, p, o, g)
        if not free:
            df = self.spark.range(1 if self.query(f"ASK {{ {text} }}") else 0)
        else:
            df = self.query(f"SELECT {' '.join('?' + n for n in free)} WHERE {{ {text} }}")
        col = lambda n, t: F.col(n) if n in free else R.const(Term(1, t) if isinstance(t, str) else t)
        return df.select(F.lit(g).alias("g"), col("s", s).alias("s"), col("p", p)["v"].alias("p"), col("o", o).alias("o"))

    def count(self, s=None, p=None, o=None, g: str = "") -> int:
        text, _ = self._pattern(s, p, o, g)
        return int(self.query(f"SELECT (COUNT(*) AS ?n) WHERE {{ {text} }}").first().n.v)

    def add(self, quads) -> None:
        body = " ".join(f"GRAPH <{q[3]}> {{ {q[0].n3} <{q[1]}> {q[2].n3} }}" if len(q) > 3 and q[3] else f"{q[0].n3} <{q[1]}> {q[2].n3} ." for q in quads)
        self.update(f"INSERT DATA {{ {body} }}")

    def remove(self, s=None, p=None, o=None, g: str = "") -> None:
        text, _ = self._pattern(s, p, o, g)
        self.update(f"DELETE WHERE {{ {text} }}")

    def dataset(self) -> Dataset:
        """A copy of the default graph and all named graphs."""
        default = self.triples()
        named = self.query("SELECT ?g ?s ?p ?o WHERE { GRAPH ?g { ?s ?p ?o } }").select(F.col("g")["v"].alias("g"), "s", F.col("p")["v"].alias("p"), "o")
        return Dataset(self.spark, default.union(named))


def jdbc_quads(spark: SparkSession, url: str, table: str = "triples", **options) -> DataFrame:
    """Quads of a table (subject, predicate, object, graph) that holds terms as N-Triples text."""
    from . import ntriples

    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return ntriples.parse_lines(rows.select(F.concat_ws(" ", "subject", "predicate", "object", F.when(F.col("graph") != "", F.col("graph")), F.lit(".")).alias("value")), "DROPMALFORMED")
