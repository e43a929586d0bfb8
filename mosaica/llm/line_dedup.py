"""Lines that recur across documents (DataFrame operations only).

Long lines are hashed; hashes are range-partitioned together with a salt of the
document, so that one common line covers many ranges, and sorted by document
and position within. One pass over each sorted run tells the first occurrence
(the document to keep) and the number of documents. The result is a run-length
coded bitmap of lines per document; texts are not moved to find it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaica.llm.common import settle, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\x0c\r"
#: Parts into which the occurrences of one line are dealt.
SALTS = 64


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Which lines each document loses: (id, text_hash, n_dropped, keep_runs).

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys
    of at least `min_chars` code points that occur in `min_docs` documents stay
    in the largest id only. keep_runs has the lengths of runs of lines, kept
    and dropped by turns, beginning with kept ones; lines after the last run
    are kept. Documents that lose nothing have no row. Rows with a null id
    aren't looked at. Rows that share an id count as one document; text_hash
    tells their texts apart.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    cut = base.select("id", F.xxhash64("text").alias("text_hash"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    cut = cut.select("id", "text_hash", "pos", F.btrim("line", F.lit(BLANK)).alias("line")).where(F.char_length("line") >= min_chars)
    key = F.translate("line", UPPER, LOWER)
    seen = settle(cut.select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"), "id", "text_hash", "pos"))

    salted = seen.select("h1", "h2", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"), "id", "pos")
    ranged = salted.repartitionByRange("h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", F.desc("id"), "pos")
    run = Window.partitionBy("h1", "h2", "salt").orderBy(F.desc("id"), "pos")
    fresh = ranged.select("h1", "h2", "id", (F.lag("id").over(run).isNull() | (F.lag("id").over(run) != F.col("id"))).alias("first_in_doc"))
    often = fresh.where("first_in_doc").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep")).where(F.col("n") >= min_docs)
    often = settle(often.select("h1", "h2", "keep"))

    lost = seen.join(often, ["h1", "h2"]).where("id <> keep")
    lost = lost.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    # a run of dropped lines opens where the line before isn't dropped and closes where the next one isn't
    lost = lost.withColumn("opens", F.filter("at", lambda p, i: ~F.coalesce(F.get("at", i - 1) == p - 1, F.lit(False))))
    lost = lost.withColumn("closes", F.filter("at", lambda p, i: ~F.coalesce(F.get("at", i + 1) == p + 1, F.lit(False))))
    runs = F.flatten(F.transform("opens", lambda p, i: F.array(p - F.coalesce(F.get("closes", i - 1) + 1, F.lit(0)), F.get("closes", i) - p + 1)))
    return lost.select(F.col("id").alias(id_col), "text_hash", F.size("at").cast("long").alias("n_dropped"), runs.alias("keep_runs"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """`docs` with recurring lines taken out of the text, plus n_lines and n_dropped (long).

    Null texts count as one empty line and stay null. Rows with a null id lose
    nothing. All other columns stay as they are, but for earlier ones of these
    two names, which are replaced.
    """
    maps = line_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    own_id, own_hash, lost, runs = unused(docs, "own_id", "own_hash", "lost", "runs")
    maps = maps.select(F.col(id_col).alias(own_id), F.col("text_hash").alias(own_hash), F.col("n_dropped").alias(lost), F.col("keep_runs").alias(runs))
    joined = docs.join(maps, (F.col(id_col) == F.col(own_id)) & (F.xxhash64(text_col) == F.col(own_hash)), "left")
    text, has = F.coalesce(F.col(text_col), F.lit("")), F.col(runs).isNotNull()
    mask = F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    stay = F.array_join(F.transform(F.filter(F.arrays_zip(_lines(text).alias("line"), mask.alias("keep")), lambda x: F.coalesce(x["keep"], F.lit(True)) & x["line"].isNotNull()), lambda x: x["line"]), "\n")
    n_lines = (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    new = {text_col: F.when(has, stay).otherwise(F.col(text_col)), "n_lines": n_lines, "n_dropped": F.coalesce(F.col(lost), F.lit(0).cast("long"))}
    return joined.select(*[new[c].alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")], *[new[c].alias(c) for c in ("n_lines", "n_dropped")])


ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (
  SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.keep AS lost
  FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (lost) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
