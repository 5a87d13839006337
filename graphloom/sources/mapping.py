"""Relational tables as a virtual graph: a row is a subject, a column a predicate, a foreign key an IRI object."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import Rep

TABLE, COLUMN = "urn:t:", "urn:c:"
#: Keys of the driver's tables; None: rows have no key and are blank nodes.
KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",),
    "orders": ("o_orderkey",), "lineitem": None, "events": ("event_id",), "documents": ("doc_id",), "labels": ("doc_id",), "pages": ("page_id",),
    "benchmark": ("item_id",), "embeddings": ("vec_id",), "conversations": ("conv_id", "turn"),
}
REFERENCES = {
    "n_regionkey": "region", "c_nationkey": "nation", "s_nationkey": "nation", "o_custkey": "customer", "l_orderkey": "orders",
    "l_partkey": "part", "l_suppkey": "supplier", "user_id": "customer",
}
#: Tables all of whose columns start alike.
PREFIX = {"region": "r_", "nation": "n_", "customer": "c_", "supplier": "s_", "part": "p_", "orders": "o_", "lineitem": "l_"}
#: Columns of money: decimals with two places.
MONEY = {"c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_extendedprice"}


@dataclass
class TableMap:
    name: str
    df: DataFrame
    keys: tuple[str, ...] | None
    references: dict[str, str] = field(default_factory=dict)
    money: frozenset = frozenset()

    @property
    def subject(self) -> tuple[Rep, Column]:
        if self.keys is None:
            return Rep("row"), F.struct(*self.df.columns)
        return self.template(self.name, self.keys)

    def template(self, table: str, cols: tuple[str, ...]) -> tuple[Rep, Column]:
        prefix = f"{TABLE}{table}/"
        if len(cols) == 1:
            kind = self.df.schema[cols[0]].dataType.simpleString()
            return (Rep("iri", prefix, "int"), F.col(cols[0]).cast("bigint")) if kind in ("int", "bigint", "smallint") else (Rep("iri", prefix), F.col(cols[0]).cast("string"))
        return Rep("iri", prefix), F.concat_ws("-", *[F.col(c).cast("string") for c in cols])

    def predicates(self) -> dict[str, str]:
        """Predicate to column, without arrays and other nested columns."""
        return {COLUMN + f.name: f.name for f in self.df.schema if f.dataType.simpleString().split("(")[0].split("<")[0] not in ("array", "map", "struct", "binary")}

    def object(self, col: str) -> tuple[Rep, Column]:
        if col in self.references:
            return self.template(self.references[col], (col,))
        kind, c = self.df.schema[col].dataType.simpleString(), F.col(col)
        if col in self.money:
            return Rep("dec"), c.cast("decimal(18,2)")
        if kind in ("int", "bigint", "smallint", "tinyint"):
            return Rep("int"), c.cast("bigint")
        if kind.startswith("decimal"):
            return Rep("dec"), c
        if kind in ("double", "float"):
            return Rep("dbl"), c.cast("double")
        if kind == "boolean":
            return Rep("bool"), c
        if kind == "date":
            return Rep("date"), c
        if kind.startswith("timestamp"):
            return Rep("dt"), c.cast("timestamp_ntz")
        return Rep("str"), c.cast("string")


def parquet_tables(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, TableMap]:
    """The driver's tables under folder; a table is opened when a query first needs it."""
    return LazyTables(spark, folder, names or list(KEYS))


class LazyTables(dict):
    def __init__(self, spark: SparkSession, folder: str, names: list[str]):
        super().__init__()
        self.spark, self.folder, self.names = spark, folder, names

    def __missing__(self, name: str) -> TableMap:
        if name not in self.names:
            raise KeyError(name)
        df = self.spark.read.parquet(os.path.join(self.folder, f"{name}.parquet"))
        mine = {c: t for c, t in REFERENCES.items() if c in df.columns}
        if name == "labels":
            mine["doc_id"] = "documents"
        self[name] = TableMap(name, df, KEYS[name], mine, frozenset(MONEY & set(df.columns)))
        return self[name]

    def __iter__(self):
        return iter(self.names)

    def __contains__(self, name):
        return name in self.names

    def __len__(self):
        return len(self.names)
