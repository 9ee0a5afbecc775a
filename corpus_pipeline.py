"""A training corpus from raw documents: filter, deduplicate, mix, pack.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept.  All but the last return the columns of ``documents``; the last returns
the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm import crf, exact, mixing, neardup, packing
from quadloom.llm.queries import tokenizer_path
from quadloom.plans.scratch import delete, materialize, scope, scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model does not reject."""
    model = crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return crf.score_quality(docs.select(*COLUMNS), model, into="_score").filter(F.col("_score") >= LEAST_QUALITY).drop("_score")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest doc_id."""
    return exact.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id."""
    return neardup.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words the mix takes: a row for each repeat of a document, cut where a block ends."""
    rows = mixing.mix(docs).drop("mix_repeat")
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 4096 tokens; ids by checksum.

    ``row`` tells the rows of one document apart, of which the mix may make several.
    """
    cut = packing.pieces(docs.withColumn("row", F.monotonically_increasing_id()), tokenizer_path(), keep=("row",))
    cut = materialize(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packing.pack(cut)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("mixing", mixture),
    ("packing", packed),
]

#: SQL can express neither the trained classifier nor the sketches and packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again.

    A stage's scratch tables go when its result is written, its result when the next one's is.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        name = name.replace(" ", "-")
        path = scratch_path(spark, name)
        with scope(spark):
            docs = materialize(stage(spark, docs, sf_dir), name, path)
        if before is not None:
            delete(spark, before)
        before = path
    return docs
