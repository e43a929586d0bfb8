"""One query per operator: production parameters, whole tables, digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaica.llm import bpe, decontaminate, embed_dedup, html_extract, langid, line_dedup, minhash, quality, token_counts, token_records
from mosaica.llm.common import fresh_path, in_training_fold

#: Where the public tokenizer files are; a name of a file there is the production parameter.
BYTE_BPE, WORD_BPE, PIECES = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_sha256(column: str):
    return F.sha2(F.coalesce(F.col(column), F.lit("")).cast("binary"), 256)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", text_sha256("text").alias("kept_sha256"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), decoded=True)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), text_sha256("decoded").alias("decoded_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(in_training_fold(F.col("doc_id"))))
    out = langid.predict(docs, model)
    return out.select("doc_id", F.coalesce(~in_training_fold(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(in_training_fold(F.col("doc_id"))))
    out = quality.score(docs, model)
    held_out = F.coalesce(~in_training_fold(F.col("doc_id")), F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-records")
    token_records.write_records(table(spark, sf_dir, "documents"), path, vocabulary(WORD_BPE), end_id=1)
    return token_records.positions(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", "n_chars")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary(PIECES))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_embedding_dedup,
        op2_line_dedup,
        op3_language_id,
        op4_quality_classifier,
        op5_token_records,
        op6_benchmark_decontamination,
        op7_byte_bpe,
        op8_minhash_dedup,
        op9_html_extraction,
        op10_token_counts,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": embed_dedup.ORACLE, "op2_line_dedup": line_dedup.ORACLE, "op6_benchmark_decontamination": decontaminate.ORACLE, "op8_minhash_dedup": minhash.ORACLE}
