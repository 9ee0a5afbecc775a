"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.frames import pick

SEED = 17


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo ``folds``; a null doc_id has fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int) -> DataFrame:
    """(text, label, weight, at) of at most ``per_class`` documents of each of the labels 0 and 1.

    Documents of the held-out fold, with other labels, or with several, are not
    taken.  They are chosen by a seeded hash of doc_id; ``weight`` is the class's
    size over the number taken, so that weighted sums stand for all labelled rows;
    ``at`` is the hash.
    """
    known = pick(labels, "doc_id", label).toDF("doc_id", "label").filter("doc_id is not null")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_hi")).filter("label = _hi and label in (0, 1)").drop("_hi")
    known = known.filter(fold(F.col("doc_id"), folds) != held_out)
    size = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    parts = []
    for value in (0, 1):
        part = known.filter(F.col("label") == value).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(per_class)
        parts.append(part.withColumn("weight", F.lit(size.get(value, 0) / max(1, min(per_class, size.get(value, 0))))))
    # at most 2 * per_class rows of 20 bytes
    chosen = F.broadcast(parts[0].unionAll(parts[1]))
    return pick(docs, "doc_id", "text").join(chosen, "doc_id").select("text", F.col("label").cast("int").alias("label"), "weight", F.xxhash64(F.lit(SEED), "doc_id").alias("at"))


def within(rows: DataFrame, budget: int) -> DataFrame:
    """The first of ``rows`` (at, size, ...; a few thousand, read twice) by ``at`` whose sizes sum to no more than ``budget``.

    Which rows these are depends on the seeded hash only, as labels share one order.
    """
    total, last = 0, None
    for at, size in sorted(tuple(r) for r in rows.select("at", "size").collect()):
        total += size
        if total > budget:
            break
        last = at
    return rows.filter(F.col("at") <= last) if last is not None else rows.limit(0)
