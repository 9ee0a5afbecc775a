"""Small helpers that make operators safe against unusual input frames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Select columns by exact name, even beside others that differ only in case.

    Of several columns with the very same name the first counts.  A missing
    column raises ``KeyError`` here instead of an analysis error later.
    """
    at: dict[str, int] = {}
    for i, c in enumerate(df.columns):
        at.setdefault(c, i)
    missing = [n for n in names if n not in at]
    if missing:
        raise KeyError(f"missing columns {missing}; there are {df.columns}")
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_c{at[n]}").alias(n) for n in names])


def carry(df: DataFrame, needed: tuple[str, ...], added: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without columns that clash with what an operator needs or adds.

    The needed columns are those of the exact name (the first of several); any
    other column that has, but for case, the name of a needed, an added or an
    earlier column is left out.  The order stays.
    """
    missing = [n for n in needed if n not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}; there are {df.columns}")
    taken = {n.lower() for n in (*needed, *added)}
    keep = []
    for i, c in enumerate(df.columns):
        if c in needed and df.columns.index(c) == i:
            keep.append((i, c))
        elif c.lower() not in taken:
            taken.add(c.lower())
            keep.append((i, c))
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_c{i}").alias(c) for i, c in keep])


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType))


def hashable(df: DataFrame) -> list[str]:
    """The columns that hash functions take: those without a map, whose entries have no order."""
    return [f.name for f in df.schema.fields if not _has_map(f.dataType)]


ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}


def local(spark: SparkSession, rows: list[tuple], **columns: str) -> DataFrame:
    """A few rows as a relation of the plan itself: its size is known, and an empty one folds away."""
    arrays = [pa.array([r[i] for r in rows], ARROW[kind]) for i, kind in enumerate(columns.values())]
    return spark.createDataFrame(pa.table(arrays, names=list(columns)))
