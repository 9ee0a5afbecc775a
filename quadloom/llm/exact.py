"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by SHA-256 digest, with a folder for
each batch.  A batch is first collapsed to its distinct digests (partial
aggregation, so a text with a third of all rows costs one row a task), then a
sort-merge anti-join keeps what the index has not seen - the index side is never
shuffled - and the rest is appended.  The batch's digests find their owners in
the index the same way; rows then find their group by a join on the digest whose
two sides are both of the batch and both shuffled, so adaptive execution splits a
hot digest.

The number of buckets and the schema are kept beside the data: who opens an index
again gets those it was made with.  A batch counts as added once its marker is
written; what an earlier attempt left without one is removed and written anew.
One application adds to an index at a time.

Defined cases: a null text counts as the empty text; null doc_id sorts below
every other; of equal rows (same doc_id and text) exactly one is kept; an empty
batch appends nothing; other columns are ignored, or carried
by ``keep_one`` unless they clash, but for case, with a needed one.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.frames import carry, pick
from quadloom.plans.scratch import materialize, scratch_path

SCHEMA = "digest binary, keep_id bigint, group_size bigint, batch string"


def text_digest(text: Column, normalize=None) -> Column:
    """SHA-256 of the normalised text in UTF-8, as 32 bytes; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2((normalize(t) if normalize else t).cast("binary"), 256))


class DigestIndex:
    """Digests seen so far, at ``path``; the same path reopens it in a later application.

    ``buckets`` is for a new index; an existing one has its own number.  A folder
    that holds something else raises ``ValueError``.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.data = f"{self.path}/table"
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        described = f"{self.path}/index.json"
        if self._fs.exists(self._path(described)):
            known = json.loads(spark.read.text(described).first()[0])
            if known.get("schema") != SCHEMA:
                raise ValueError(f"{path}: another kind of index: {known}")
            self.buckets = int(known["buckets"])
        else:
            if self._fs.exists(self._path(self.path)) and len(self._fs.listStatus(self._path(self.path))):
                raise ValueError(f"{path}: not an index")
            self.buckets = buckets
            self._put(described, json.dumps({"schema": SCHEMA, "buckets": buckets}))
        self._fs.mkdirs(self._path(self.data))
        self.name = "digest_index_" + uuid.uuid4().hex
        spark.sql(f"CREATE TABLE {self.name} ({SCHEMA}) USING parquet OPTIONS (path '{self.data}') PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS")
        self._found()

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _put(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _marker(self, batch: str) -> str:
        return f"{self.path}/batches/{hashlib.sha256(batch.encode()).hexdigest()}"

    def _found(self) -> None:
        """Let the catalog see the folders of batches."""
        self.spark.catalog.recoverPartitions(self.name)
        self.spark.catalog.refreshTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def has(self, batch: str) -> bool:
        return self._fs.exists(self._path(self._marker(batch)))

    def is_only(self, batch: str) -> bool:
        """Whether the index holds no other batch."""
        at = self._path(f"{self.path}/batches")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return set(names) <= {self._marker(batch).rsplit("/", 1)[-1]}

    def add(self, digests: DataFrame, batch: str) -> None:
        """Append the digests of ``digests`` (doc_id, digest) that are new, under the batch's name.

        A batch that is already there is not added again, so a rerun after a failure is safe.
        """
        if self.has(batch):
            return
        folder = "batch=" + self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(batch)
        if self._fs.delete(self._path(f"{self.data}/{folder}"), True):
            self._found()
        groups = digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        fresh = groups.repartition(self.buckets, "digest").join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        rows = fresh.withColumn("batch", F.lit(batch)).write.format("parquet").mode("append").option("path", self.data)
        rows.partitionBy("batch").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        self._put(self._marker(batch), batch)
        self._found()

    def owners(self, digests: DataFrame) -> DataFrame:
        """digest, keep_id, group_size, batch of the distinct digests of ``digests``; the index is not shuffled."""
        wanted = digests.select("digest").distinct().repartition(self.buckets, "digest")
        return wanted.join(self.table().hint("merge"), "digest")

    def files(self) -> DataFrame:
        """The whole index as plain files, in no known order."""
        return self.spark.read.schema(SCHEMA).parquet(self.data)

    def close(self) -> None:
        """Forget the catalog's entry; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests_of(docs: DataFrame, normalize=None) -> DataFrame:
    d = pick(docs, "doc_id", "text")
    return materialize(d.select("doc_id", text_digest(F.col("text"), normalize).alias("digest")), "digests")


def judge(digests: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """Each row of ``digests`` with keep_id, group_size and kept, once ``batch`` is in the index.

    Kept is the row with the largest doc_id among the batch's rows of a digest the
    index had not seen before this batch.
    """
    # without a history the index is the batch's own digests; else only those owners take part that the batch asks for
    owners = index.files() if index.is_only(batch) else materialize(index.owners(digests), "owners")
    owners = owners.withColumn("_fresh", F.col("batch") == batch).drop("batch")
    rows = digests.groupBy("digest", "doc_id").agg(F.count("*").alias("_rows"))
    d = rows.join(owners.hint("merge"), "digest")
    best = F.col("_fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    d = d.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "_rows")))
    return d.select("doc_id", "digest", "keep_id", "group_size", (best & (F.col("_n") == 1)).alias("kept"))


def exact_dedup(docs: DataFrame, index_path: str | None = None, batch: str = "0", normalize=None, buckets: int = 64) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept for each row; ``index_path`` None: an index of this batch only."""
    spark = docs.sparkSession
    index = DigestIndex(spark, index_path or scratch_path(spark, "digest-index"), buckets)
    try:
        digests = digests_of(docs, normalize)
        index.add(digests, batch)
        return judge(digests, index, batch)
    finally:
        index.close()


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, one of each text, with all their columns."""
    kept = exact_dedup(docs, **options).filter("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    docs = carry(docs, ("doc_id", "text"), ("_own", "_id", "_digest"))
    d = docs.withColumn("_own", text_digest(F.col("text"), options.get("normalize")))
    d = d.join(kept.hint("merge"), d.doc_id.eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_digest")), "left_semi")
    return d.dropDuplicates(["doc_id", "_own"]).drop("_own")
