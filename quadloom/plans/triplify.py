"""Relational tables as quads, and the schema that reads them back as entities.

Each (table, predicate) pair is one branch of a union with constant predicate,
so a path that needs three predicates scans three narrow column sets.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.frames import local
from quadloom.functions.terms import OWL, RDF_TYPE
from quadloom.sources.pathbuilder import Path, Pathbuilder, from_paths

BASE = "urn:t:"
SAME, INVERSE = OWL + "sameAs", OWL + "inverseOf"


def uri(kind: str, *keys: str | Column) -> Column:
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.concat(F.lit(f"{BASE}{kind}/"), F.concat_ws("-", *[p.cast("string") for p in parts]))


def _rows(df: DataFrame, ord_: Column, slot: int, s: Column, p: str, o: Column | None = None, value: Column | None = None, lang: Column | None = None, graph: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = df.select((ord_ * 64 + slot).cast("bigint").alias("ord"), s.alias("s"), F.lit(p).alias("p"), (o if o is not None else none).alias("o"), (value if value is not None else none).cast("string").alias("value"), (lang if lang is not None else F.lit("")).alias("lang"), none.alias("datatype"), (graph if graph is not None else F.lit("")).alias("graph"))
    return rows.filter("s is not null and (o is not null or value is not null)")


#: table: (class, key columns, place of its rows in the order, object properties (name, kind, columns), data properties)
TABLES = {
    "region": ("Region", ["r_regionkey"], [], [("name", "r_name")]),
    "nation": ("Nation", ["n_nationkey"], [("inRegion", "region", ["n_regionkey"])], [("name", "n_name")]),
    "customer": ("Customer", ["c_custkey"], [("inNation", "nation", ["c_nationkey"])], [("name", "c_name"), ("mktsegment", "c_mktsegment")]),
    "supplier": ("Supplier", ["s_suppkey"], [("supplierNation", "nation", ["s_nationkey"])], [("name", "s_name")]),
    "part": ("Part", ["p_partkey"], [], [("name", "p_name"), ("brand", "p_brand"), ("ptype", "p_type")]),
    "orders": ("Order", ["o_orderkey"], [("placedBy", "customer", ["o_custkey"])], [("status", "o_orderstatus"), ("priority", "o_orderpriority")]),
    "lineitem": ("LineItem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"], [("ofOrder", "order", ["l_orderkey"]), ("ofPart", "part", ["l_partkey"]), ("fromSupplier", "supplier", ["l_suppkey"])], [("returnflag", "l_returnflag"), ("linestatus", "l_linestatus")]),
}
KIND = {"orders": "order"}


def star_parts(spark: SparkSession, sf_dir: str, tables: Iterable[str], inverses: Iterable[tuple[str, str]] = ()) -> dict[str, DataFrame]:
    """Statements of the star schema's tables by predicate; ``inverses`` come first in the order."""
    stated = [(-1000 + i, BASE + a, INVERSE, BASE + b, None, "", None, "") for i, (a, b) in enumerate(inverses)]
    out = {INVERSE: local(spark, stated, ord="bigint", s="string", p="string", o="string", value="string", lang="string", datatype="string", graph="string")}

    def add(name: str, rows: DataFrame) -> None:
        out[name] = out[name].unionAll(rows) if name in out else rows

    for at, name in enumerate(tables):
        cls, keys, objects, data = TABLES[name]
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        # day of a time stamp, in the session's zone
        key = [F.date_format(k, "yyyy-MM-dd") if k == "l_shipdate" else F.col(k) for k in keys]
        s = uri(KIND.get(name, name), *key)
        # unique in a table by its keys, apart between tables by the place in the list
        ord_ = (F.col(keys[0]).cast("bigint") if len(keys) == 1 else F.abs(F.xxhash64(*key)) % (1 << 48)) * 8 + at
        add(RDF_TYPE, _rows(df, ord_, 0, s, RDF_TYPE, F.lit(BASE + cls)))
        for i, (p, kind, cols) in enumerate(objects):
            add(BASE + p, _rows(df, ord_, 1 + i, s, BASE + p, uri(kind, *cols)))
        for i, (p, c) in enumerate(data):
            add(BASE + p, _rows(df, ord_, 9 + i, s, BASE + p, None, F.col(c)))
    return out


def star_quads(spark: SparkSession, sf_dir: str, tables: Iterable[str], inverses: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """``star_parts`` in one table."""
    return functools.reduce(DataFrame.unionAll, star_parts(spark, sf_dir, tables, inverses).values())


def document_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: class, the text as a literal in the document's language, source as graph; the
    smallest id of each text is stated the same as the text's others."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("_digest", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    s = uri("doc", "doc_id")
    graph = F.concat(F.lit(BASE + "source/"), F.col("source"))
    ord_ = F.col("doc_id")
    kind = _rows(d, ord_, 0, s, RDF_TYPE, F.lit(BASE + "Document"), graph=graph)
    text = _rows(d, ord_, 1, s, BASE + "text", None, F.col("text"), F.col("lang"), graph)
    first = d.groupBy("_digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = d.select("doc_id", "_digest").join(first, "_digest").filter("doc_id <> first")
    same = _rows(copies, ord_, 2, uri("doc", "first"), SAME, s)
    return same.unionAll(kind).unionAll(text)


def _p(id: str, steps: list[str], group: str = "", datatype: str = "", is_group: bool = False) -> Path:
    return Path(id, [BASE + x for x in steps], BASE + datatype if datatype else "", is_group, group)


def customer_schema() -> Pathbuilder:
    """Customers with name, segment and nation; their orders, by the inverse of placedBy, as children."""
    return from_paths(
        [
            _p("customer", ["Customer"], is_group=True),
            _p("cname", ["Customer"], "customer", "name"),
            _p("segment", ["Customer"], "customer", "mktsegment"),
            _p("nation", ["Customer", "inNation", "Nation"], "customer", "name"),
            _p("nation_ref", ["Customer", "inNation", "Nation"], "customer"),
            _p("orders", ["Customer", "hasOrder", "Order"], "customer", is_group=True),
            _p("status", ["Customer", "hasOrder", "Order"], "orders", "status"),
            _p("priority", ["Customer", "hasOrder", "Order"], "orders", "priority"),
        ]
    )
