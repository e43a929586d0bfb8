"""From raw documents to encoded training text, in stages.

Each stage calls one operator and takes effect on all the documents that the
stage before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaica.llm import bpe, decontaminate, line_dedup, minhash, quality
from mosaica.llm.common import fresh_path, in_training_fold, remove_path, unused
from mosaica.llm.queries import BYTE_BPE, table, text_sha256, vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Score that a document must reach to stay.
QUALITY = 0.7


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, null and empty texts by their score as any other. It learns from labels outside the held-out fold."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(in_training_fold(F.col("doc_id"))))
    return docs.where(quality.score_column(spark, model, F.col("text")) >= QUALITY)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from the texts; n_chars follows. Null texts stay null, with a null n_chars."""
    out = line_dedup.drop_lines(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")))
    return out.select(*docs.columns)


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, by shingles of five words, the document with the smallest id stays. Of rows that share an id equal ones stay once; rows without an id stay, equal ones once."""
    found = minhash.near_duplicates(docs, shingle=5, percent=80)
    lost = found.where(~F.col("kept")).select("doc_id")
    left = docs.join(lost, "doc_id", "left_anti")
    # whole rows are compared only where an id occurs twice
    twice = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("twice_id"))
    if twice.isEmpty():
        return left
    again = F.col("doc_id").eqNullSafe(F.col("twice_id"))
    return left.join(twice, again, "left_anti").unionByName(left.join(twice, again, "left_semi").dropDuplicates())


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null texts hold none."""
    hit = decontaminate.hits_column(spark, F.col("text"), table(spark, sf_dir, "benchmark"))
    (found,) = unused(docs, "found")
    return docs.withColumn(found, hit).where(F.col(f"{found}.n_hit") == 0).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, checked by decoding them: doc_id, n_tokens, ids (little-endian unsigned 32-bit), ids_sha256, decoded_sha256. Null texts are empty ones; rows with a null id stay."""
    out = bpe.encode(docs, vocabulary(BYTE_BPE), decoded=True)
    n = (F.length("ids") / 4).cast("long")
    return out.select("doc_id", n.alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), text_sha256("decoded").alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents),
    ("lines", fresh_lines),
    ("near_duplicates", unlike_documents),
    ("decontamination", uncontaminated),
    ("encoding", encoded),
]
#: The classifier's stage has no form in SQL; tests hold the other stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table is deleted once the next one is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        out = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if last:
            remove_path(spark, last)
        last = out
    return docs
