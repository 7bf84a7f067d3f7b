"""The operators of this folder as named queries over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import block_search, bpe_automaton, chat_format, decontaminate, embedding_dedup, license_scan, maxent_lm, ngram_jaccard, pii_crf, substring_dedup, token_alignment, toxicity, warc
from tallyhouse.llm.staging import Stage
from tallyhouse.session import conf

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha256(column: str) -> F.Column:
    return F.sha2(F.col(column).cast("binary"), 256)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.cut_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", _sha256("kept_text").alias("kept_sha256"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.derived_records(warc.response_records(_table(spark, sf_dir, "pages")))
    return found.select("page_id", "type", "record_id", "refers_to", "target_uri", "date", "block_digest", "payload_digest", "content_length", _sha256("header").alias("header_sha256"), _sha256("block").alias("block_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_labels(license_scan.license_spans(_table(spark, sf_dir, "documents")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    made = bpe_automaton.encode_decode(docs, vocabulary_path())
    digests = made.select("doc_id", "n_tokens", _sha256("ids").alias("ids_sha256"), _sha256("decoded").alias("decoded_sha256"))
    # Staged, as the size of batches is that of the moment when a plan runs.
    with conf(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}):
        return Stage(docs.sparkSession, "bpe").put(digests)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.scored(_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaked_regions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.leaks(found)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), carry=["doc_id"])
    return found.select("row.doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", F.col("flagged").cast("int").alias("flagged"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    control = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said))
    return chat_format.read_back(chat_format.format_conversations(chat_format.rows_to_records(rows.union(control))))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.digests(pii_crf.personal_data(_table(spark, sf_dir, "documents")))


def op12_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    own = [op1_substring_dedup, op2_ngram_jaccard, op3_warc_derivatives, op4_license_scan, op5_bpe, op6_embedding_dedup, op7_lm_score, op8_decontaminate, op9_toxicity, op10_chat_format, op11_personal_data, op12_block_search, op13_token_alignment, pipeline]
    return {f.__name__: f for f in own}
