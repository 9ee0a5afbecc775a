"""Two-pass external shuffle into shards.

Pass one scatters records by seeded hashes into buckets that fit in memory:
first the shard, by highest-random-weight hashing of (doc_id, shard), then a
bucket inside the shard.  Pass two loads one bucket at a time, puts it in a
Fisher-Yates order (numpy's ``permutation``) seeded by the bucket, and writes it.
A record's slot is its place in the bucket after the rows of the shard's earlier
buckets.  How many buckets there are and what each holds comes from one scan,
which counts rows and bytes of ``CELLS`` hash ranges a shard; a bucket is some
neighbouring ranges.  The number of tasks follows the bytes, not the session.

The law is ``key``: doc_id and the number of shards decide, and one more shard
takes rows only into itself, as each row's best shard changes only if the new
one beats it.

Defined cases: null doc_id is a key like any other; null text adds no bytes;
an empty table makes no rows; repeated rows are all kept, and since rows of one
doc_id belong to one shard by the law, they are dealt over its buckets by their
other columns (rows equal in all of these share a bucket; maps, which have no
order, don't count); columns named, but for case, like a needed or an added one (shard, bucket, slot)
give way to it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.functions.frames import carry, hashable
from quadloom.plans.scratch import materialize, scratch_path

ADDED = ("shard", "bucket", "slot")
CELL_BITS = 16
CELLS = 1 << CELL_BITS


def shard_of(doc_id: Column, shards: int, seed: int) -> Column:
    scores = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), doc_id, s).alias("h"), s.alias("s")))
    return F.array_max(scores)["s"]


def shuffled(docs: DataFrame, shards: int = 24, seed: int = 17, bucket_bytes: int = 4 << 20, bytes_a_task: int = 16 << 20, most_tasks: int = 50_000) -> DataFrame:
    """``docs`` with shard, bucket and slot (gapless from 0 in each shard).

    ``bucket_bytes`` bounds the mean bucket, which is what one task holds at once, up to
    ``CELLS`` buckets a shard.  A task deals the buckets of about ``bytes_a_task``
    one after the other, more if there would be over ``most_tasks``.
    """
    if shards < 1 or bucket_bytes < 1 or bytes_a_task < 1 or most_tasks < 1:
        raise ValueError("shards, bucket_bytes, bytes_a_task and most_tasks are 1 or more")
    docs = carry(docs, ("doc_id", "text"), (*ADDED, "_h", "_tie", "_cell"))
    keys = docs.withColumn("shard", shard_of(F.col("doc_id"), shards, seed)).withColumn("_tie", F.xxhash64(F.lit(seed + 1), *hashable(docs)))
    keys = keys.withColumn("_cell", F.shiftrightunsigned("_tie", 64 - CELL_BITS))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(8).cast("long")
    cells = materialize(keys.groupBy("shard", "_cell").agg(F.count("*").alias("rows"), F.sum(size).alias("bytes")), "cells")
    total = cells.agg(F.sum("bytes")).first()[0] or 0
    per_shard = min(CELLS, max(1, math.ceil(total / shards / bucket_bytes)))
    # a cell's bucket: cells are ranges of the hash, buckets are ranges of cells
    bucket = F.floor(F.col("_cell") * per_shard / F.lit(CELLS)).cast("int")
    counts = cells.groupBy("shard", bucket.alias("bucket")).agg(F.sum("rows").alias("count"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("count").over(earlier), F.lit(0)).cast("long")
    starts = counts.select("shard", "bucket", base.alias("base")).toDF("_shard", "_bucket", "base")
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("slot", T.LongType())])
    names = docs.columns

    def deal(key, rows: pa.Table, start: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.select([*names, "shard", "bucket"]).append_column("slot", pa.array([], pa.int64()))
        shard, bucket = (int(k.as_py()) for k in key)
        # a defined order first, whatever order the shuffle delivered
        order = np.lexsort([rows.column("_tie").to_numpy(), rows.column("_h").to_numpy()])
        n = rows.num_rows
        order = order[np.random.Generator(np.random.PCG64([seed, shard, bucket])).permutation(n)]
        out = rows.select([*names, "shard", "bucket"]).take(pa.array(order))
        slots = start.column("base")[0].as_py() + np.arange(n, dtype=np.int64)
        return out.append_column("slot", pa.array(slots))

    session = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(shards * per_shard, most_tasks, max(session, math.ceil(total / bytes_a_task)))
    keys = keys.withColumn("bucket", bucket).withColumn("_h", F.xxhash64(F.lit(seed + 2), "doc_id")).drop("_cell")
    keys, starts = keys.repartition(tasks, "shard", "bucket"), starts.repartition(tasks, "_shard", "_bucket")
    return keys.groupBy("shard", "bucket").cogroup(starts.groupBy("_shard", "_bucket")).applyInArrow(deal, schema)


def write_shards(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the shuffled rows below ``path`` (one folder a shard) and return a reader of them."""
    rows = shuffled(docs, **options)
    path = path or scratch_path(docs.sparkSession, "shards")
    rows.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)
