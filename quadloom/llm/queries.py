"""The queries over this subpackage's operators: thin projections of what they return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.frames import pick
from quadloom.llm import crf, exact, language, linedup, mixing, neardup, packing, repetition, sharding, toxicity
from quadloom.llm.samples import fold
from quadloom.plans.scratch import materialize

SHARDS = 24


def _read(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir)
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    rows = toxicity.toxic_sentences(docs, model)
    held_out = fold(F.col("doc_id"), 4) == 2
    predicted = (F.col("score") >= 0.3).cast("int")
    return rows.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"), F.size("offending").alias("n_offending"))


def op2_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(_read(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact.exact_dedup(_read(spark, sf_dir))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(_read(spark, sf_dir), tokenizer_path())
    cut = materialize(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packing.pack(cut)


def op5_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir)
    rows = sharding.write_shards(docs, shards=SHARDS)
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        sharding.shard_of(F.col("doc_id"), SHARDS + 1, 17).alias("grown_shard"),
    )


def op6_patience_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linedup.drop_common_blocks(_read(spark, sf_dir))
    return rows.select("doc_id", "n_lines", "removed_lines", "removed_words", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("clean_sha256"))


def op7_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(_read(spark, sf_dir))


def op8_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir)
    model = crf.train(docs, _read(spark, sf_dir, "labels"))
    rows = crf.score_quality(pick(docs, "doc_id", "text"), model)
    held_out = fold(F.col("doc_id"), 3) == 1
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir)
    rows = language.languages(docs, language.train(docs))
    held_out = fold(F.col("doc_id"), 4) == 2
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op10_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_noisy_or_toxicity,
        op2_sainte_lague_mix,
        op3_exact_dedup,
        op4_sum_of_squares_packing,
        op5_external_shuffle,
        op6_patience_line_dedup,
        op7_repetition_rules,
        op8_line_crf_quality,
        op9_viterbi_language,
        op10_hyperminhash,
    )
}

ORACLES = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
}
