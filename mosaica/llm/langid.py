"""Language of a text: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams in hash buckets by language give a matrix of log
probabilities, bounded by BUCKETS times the number of languages, which is
broadcast. Texts are scored in batches of code points: each n-gram looks up its
row of the matrix, rows are summed by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaica.llm.bpe import slices

BUCKETS = 1 << 16
GRAMS = (1, 2, 3)
#: Labelled documents to learn from at most, those with the least hashes of their ids.
SAMPLE = 10_000
SMOOTHING = 0.5
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, each between blanks, with runs of ASCII other than letters as one blank; and where each text begins."""
    joined = "\x00 " + " \x00 ".join(t.lower().replace("\x00", " ") for t in texts) + " "
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.where((c < 128) & (c != 0) & ~((c >= 97) & (c <= 122)), np.uint32(32), c)
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    return c, np.flatnonzero(c == 0)


def buckets(c: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each place; marks between texts have one of their own."""
    h = np.full(len(c) - n + 1, 0x9E3779B9 + n, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ c[k : k + len(h)]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
    return (h >> np.uint32(7)) & np.uint32(BUCKETS - 1)


def text_sums(texts: list[str], table: np.ndarray) -> np.ndarray:
    """For each text the sum of the rows of `table` over its n-grams that don't reach into a neighbour."""
    c, at = codes(texts)
    out = np.zeros((len(texts), table.shape[1]))
    for n in GRAMS:
        rows = table[buckets(c, n)]
        clean = np.ones(len(rows), bool)
        for k in range(n):
            clean &= c[k : k + len(rows)] != 0
        rows[~clean] = 0
        out += np.add.reduceat(rows, np.minimum(at, len(rows) - 1), axis=0, dtype=np.float64) if len(rows) else 0
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities, [BUCKETS, languages] with the prior in a last row, from at most `sample` rows of `docs`.

    Rows without a language or text don't count. No rows: no languages.
    """
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    some = read.select("id", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(sample)
    bound = some.agg(F.max(F.struct("h", "id"))).first()[0]
    if bound is None:
        return [], np.zeros((BUCKETS + 1, 0), np.float32)
    chosen = read.where(F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("id")) <= F.struct(F.lit(bound[0]).alias("h"), F.lit(bound[1]).alias("id")))

    def count(batches):
        for pdf in batches:
            for lang, group in pdf.groupby("lang"):
                total, texts = np.zeros(BUCKETS, np.int64), group["text"].tolist()
                for a, b in slices(texts, 1_000_000):
                    c, _ = codes(texts[a:b])
                    for n in GRAMS:
                        h = buckets(c, n)
                        clean = np.ones(len(h), bool)
                        for k in range(n):
                            clean &= c[k : k + len(h)] != 0
                        total += np.bincount(h[clean], minlength=BUCKETS)
                seen = np.flatnonzero(total)
                yield pd.DataFrame({"lang": lang, "bucket": [*seen, -1], "n": [*total[seen], len(group)]})

    counts = chosen.select("lang", "text").mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((BUCKETS, len(langs)))
    prior = np.zeros(len(langs))
    for k, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        docs_of = own["bucket"] == -1
        prior[k] = own.loc[docs_of, "n"].sum()
        table[own.loc[~docs_of, "bucket"].to_numpy(), k] = own.loc[~docs_of, "n"]
    logs = np.log(table + SMOOTHING) - np.log(table.sum(0) + SMOOTHING * BUCKETS)
    return langs, np.vstack([logs, np.log(prior / prior.sum())]).astype(np.float32)


def predict_column(spark: SparkSession, model: tuple[list[str], np.ndarray], text: str | Column) -> Column:
    """A column of structs: lang_pred and score, the probability of that language among those learned, of each whole text.

    Null texts, texts without a letter, and all texts if nothing was learned
    are `und` with score 0. Ties go to the first language in order.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        langs, table = shared.value
        for column in batches:
            texts = [t if langs and t and _LETTER.search(t) else "" for t in column.to_pylist()]
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for a, b in slices(texts, 1_000_000):
                own = [i for i in range(a, b) if texts[i]]
                if own:
                    sums = text_sums([texts[i] for i in own], table[:-1]) + table[-1]
                    best = sums.argmax(1)
                    score[own] = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
                    for i, k in zip(own, best.tolist(), strict=True):
                        lang[i] = langs[k]
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang_pred", "score"])

    return predicted(text)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, lang_pred and score, as `predict_column` has them. Ids do not pass through Python."""
    read = docs.select(F.col(id_col), predict_column(docs.sparkSession, model, F.col(text_col).cast("string")).alias("__got"))
    return read.select(id_col, "__got.*")
