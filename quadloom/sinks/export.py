"""Exports: wide and long tables, CSV, JSON, databases, and triples as text."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.operators.entities import BundleTables, long, nested, wide
from quadloom.sources.nquads import _label, literal


def tables(bundles: dict[str, BundleTables], shape: str = "wide", separator: str = "; ", cell_format: str = "value") -> dict[str, DataFrame]:
    """Table name to rows, for all bundles and their children.

    ``wide``: ``bundle__<name>`` with a column for each field; ``long``: the same
    without fields, beside ``field__<bundle>__<field>`` (uri, value, lang).
    """
    out = {}
    for top in bundles.values():
        for t in top.walk():
            name = f"bundle__{t.bundle.machine_name}"
            if shape == "wide":
                out[name] = wide(t, separator, cell_format)
            elif shape == "long":
                keys = t.entity.select("uri")
                out[name] = keys if t.links is None else keys.join(t.links, "uri").select("uri", "parent")
                out |= long(t)
            else:
                raise ValueError(f"shape: {shape}")
    return out


def to_csv(frames: dict[str, DataFrame], path: str) -> None:
    """A folder of CSV files for each table, with a header; null is an empty cell."""
    for name, df in frames.items():
        df.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(f"{path}/{name}")


def to_parquet(frames: dict[str, DataFrame], path: str) -> None:
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def to_jdbc(frames: dict[str, DataFrame], url: str, properties: dict[str, str] | None = None, batch_size: int = 1000) -> None:
    """Drop and recreate each table through a JDBC driver on the class path."""
    if batch_size < 1:
        raise ValueError("batch_size is 1 or more")
    for name, df in frames.items():
        df.write.mode("overwrite").option("batchsize", batch_size).jdbc(url, name, properties=properties or {})


def batches(rows: Iterator, columns: int, batch_size: int, max_variables: int) -> Iterator[list]:
    """Lists of rows, none with more values than a statement may have variables."""
    size = min(batch_size, max_variables // max(1, columns))
    if size < 1:
        raise ValueError("a row has more columns than a statement may have variables")
    while chunk := list(islice(rows, size)):
        yield chunk


def to_sqlite(frames: dict[str, DataFrame], path: str, batch_size: int = 1000, max_variables: int = 32766) -> None:
    """One SQLite file, written by the driver partition by partition; tables are dropped and recreated."""
    quote = lambda n: '"' + n.replace('"', '""') + '"'
    db = sqlite3.connect(path)
    try:
        for name, df in frames.items():
            columns = ", ".join(f"{quote(c)} TEXT{' NOT NULL' if c == 'uri' else ''}" for c in df.columns)
            db.execute(f"DROP TABLE IF EXISTS {quote(name)}")
            db.execute(f"CREATE TABLE {quote(name)} ({columns})")
            one = "(" + ", ".join("?" * len(df.columns)) + ")"
            for chunk in batches(df.toLocalIterator(), len(df.columns), batch_size, max_variables):
                db.execute(f"INSERT INTO {quote(name)} VALUES {', '.join([one] * len(chunk))}", [v for r in chunk for v in r])
            db.commit()
    finally:
        db.close()


def json_rows(t: BundleTables) -> DataFrame:
    """One JSON document an entity, with its fields and children."""
    df = nested(t)
    return df.select("uri", F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def to_json(bundles: dict[str, BundleTables], path: str) -> None:
    """JSON lines, a folder for each bundle."""
    for name, t in bundles.items():
        nested(t).write.mode("overwrite").json(f"{path}/{name}")


def to_json_document(bundles: dict[str, BundleTables], path: str) -> None:
    """One JSON object in one local file: the name of each bundle with the list of its entities, sorted by uri.

    Entities come to the driver one by one, not together; for large results use ``to_json``.
    """
    with open(path, "w", encoding="utf-8") as out:
        out.write("{")
        for i, (name, t) in enumerate(sorted(bundles.items())):
            out.write(f"{', ' if i else ''}{json.dumps(name)}: [")
            for k, r in enumerate(json_rows(t).orderBy("uri").toLocalIterator()):
                out.write((",\n" if k else "\n") + r.json)
            out.write("]")
        out.write("}\n")


def _ends(canonical: bool) -> tuple[str, str, str]:
    return ("s_subject", "s_predicate", "s_object") if canonical else ("subject", "predicate", "object")


def ntriples(triples: DataFrame, canonical: bool = True) -> DataFrame:
    """``triples`` plus ``line``, the statement in N-Triples."""
    s, p, o = _ends(canonical)
    obj = F.when(F.col(o).isNotNull(), _label(F.col(o))).otherwise(literal(F.col("value"), F.col("lang")))
    return triples.withColumn("line", F.concat(_label(F.col(s)), F.lit(" "), _label(F.col(p)), F.lit(" "), obj, F.lit(" .")))


def turtle(triples: DataFrame, canonical: bool = True) -> DataFrame:
    """(uri, turtle): for each uri of ``triples`` one text; statements share subjects and predicates, in order of ``tid``."""
    s, p, o = _ends(canonical)
    obj = F.when(F.col(o).isNotNull(), _label(F.col(o))).otherwise(literal(F.col("value"), F.col("lang")))
    t = triples.select("uri", "tid", _label(F.col(s)).alias("s"), _label(F.col(p)).alias("p"), obj.alias("o"))
    by_p = t.groupBy("uri", "s", "p").agg(F.min("tid").alias("tid"), F.array_sort(F.collect_list(F.struct("tid", "o"))).alias("x"))
    by_p = by_p.withColumn("po", F.concat("p", F.lit(" "), F.array_join("x.o", ", ")))
    by_s = by_p.groupBy("uri", "s").agg(F.min("tid").alias("tid"), F.array_sort(F.collect_list(F.struct("tid", "po"))).alias("x"))
    by_s = by_s.withColumn("text", F.concat("s", F.lit(" "), F.array_join("x.po", " ;\n    "), F.lit(" .")))
    return by_s.groupBy("uri").agg(F.array_join(F.array_sort(F.collect_list(F.struct("tid", "text")))["text"], "\n").alias("turtle"))


def graph_view(triples: DataFrame) -> DataFrame:
    """(uri, edges, literals): canonical [s, p, o] and [s, p, value, lang], as a graph drawing needs them."""
    edge = F.when(F.col("s_object").isNotNull(), F.array("s_subject", "s_predicate", "s_object"))
    datum = F.when(F.col("s_object").isNull(), F.array("s_subject", "s_predicate", "value", "lang"))
    return triples.groupBy("uri").agg(F.array_sort(F.collect_list(edge)).alias("edges"), F.array_sort(F.collect_list(datum)).alias("literals"))
