"""Token ids as length-delimited binary records with a separate offset index.

A record is: payload length (unsigned 64-bit), masked checksum of those eight
bytes (unsigned 32-bit), payload, masked checksum of the payload, and a line
feed. Numbers are little-endian. The checksum is zlib's CRC-32, masked by a
rotation and a constant so that checksums of data that hold checksums stay
sound. A payload is: a byte (1: an id follows; 2: ids take four bytes instead of
two), the document's id (signed 64-bit), the number of tokens (unsigned 32-bit)
and the tokens. Every file can be read from any offset of the index.

Spark's text writer stores the records, so that task retries and lost executors
leave no partial files and any Hadoop store will do. A row of the writer is a
chunk of records; it ends each with the line feed that closes the last of them,
and begins a new file after a fixed number of chunks, which bounds the files in
bytes (a document of its own size apart).
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaica.llm.bpe import byte_kinds, byte_letters, by_script
from mosaica.llm.pool import Pool, Words, cut, latin

HEAD, PAYLOAD, SUM = struct.Struct("<QI"), struct.Struct("<BqI"), struct.Struct("<I")
#: Distinct parts of texts whose ids a worker keeps at most.
MAX_CACHED = 600_000
#: Bytes of records after which a chunk ends, and chunks of a file: files have CHUNK * CHUNKS bytes and a document at most.
CHUNK, CHUNKS = 1 << 20, 64


def masked_crc(data: bytes | memoryview) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record without the line feed that the writer adds."""
    head = struct.pack("<Q", len(payload))
    return head + SUM.pack(masked_crc(head)) + payload + SUM.pack(masked_crc(payload))


def records(data: bytes | pa.Buffer, at: int = 0):
    """(offset, length, document id, ids as unsigned 32-bit numbers) of each record of a file from byte `at` on; a wrong checksum is an error."""
    data = memoryview(data)
    while at < len(data):
        size, check = HEAD.unpack_from(data, at)
        body = data[at + HEAD.size : at + HEAD.size + size]
        if check != masked_crc(data[at : at + 8]) or len(body) != size or SUM.unpack_from(data, at + HEAD.size + size)[0] != masked_crc(body):
            raise ValueError(f"record at byte {at}: wrong checksum")
        end = at + HEAD.size + size + SUM.size + 1
        kind, doc, n = PAYLOAD.unpack_from(body)
        ids = np.frombuffer(body, "<u4" if kind & 2 else "<u2", n, PAYLOAD.size).astype("<u4")
        yield at, end - at, doc if kind & 1 else None, ids
        at = end


def record(doc: int | None, ids: bytes, wide: bool) -> bytes:
    """The frame of one document's ids, given as two- or four-byte numbers."""
    return frame(PAYLOAD.pack((doc is not None) + 2 * wide, doc or 0, len(ids) // (4 if wide else 2)) + ids)


class WordEncoder:
    """The tokenizers library, asked once for each distinct part of the texts.

    For files whose normaliser and pre-tokeniser never look across white space
    and whose tokens at word ends are marked; others are refused. A text's ids
    are those of its parts: the words of the pre-tokeniser where a text is
    Latin-1 (which NFC leaves alone and which lower-cases letter by letter) and
    holds no added token, the runs between blanks otherwise. New words go to the
    library's model many at a time, in the letters that it has for bytes, and
    marked tokens tell where each ends; new runs go through the whole tokenizer.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Parts in one text for the library.
    JOINED = 500

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._check(path, spec)
        self.inner = Tokenizer.from_file(path)
        self.inner.no_padding()
        self.inner.no_truncation()
        # words are cut and lower-cased already: what is left to do is the model's
        self.bare = Tokenizer(self.inner.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = {b: c for c, b in byte_letters().items() if b != 32}
        self.wide = self.inner.get_vocab_size() > 65536
        self.dtype = "<u4" if self.wide else "<u2"
        self.words, self.pool = Words(self.dtype, MAX_CACHED), Pool(self.dtype, MAX_CACHED)
        mark = spec["model"]["end_of_word_suffix"]
        self.last = np.zeros(self.inner.get_vocab_size(), bool)
        self.last[[i for t, i in spec["model"]["vocab"].items() if t.endswith(mark)]] = True
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.blank = re.compile(r"[ \t\n\r\x0b\x0c]+")
        self.kinds = byte_kinds()
        self.lower = np.array([ord(chr(c).lower()) for c in range(256)], np.uint8)

    def _check(self, path: str, spec: dict) -> None:
        steps = [(n["type"], n.get("pattern", {}).get("Regex"), n.get("content")) for n in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        model = spec["model"]
        sound = (
            steps == [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)]
            and [p["type"] for p in pre] == ["Split", "ByteLevel"]
            and pre[0]["pattern"] == {"Regex": self.PATTERN}
            and (pre[0]["behavior"], pre[0]["invert"]) == ("Removed", True)
            and not pre[1]["add_prefix_space"]
            and not pre[1]["use_regex"]
            and model["type"] == "BPE"
            and not model["dropout"]
            and model["end_of_word_suffix"]
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or not t["content"] or t["content"].split() != [t["content"]] for t in spec["added_tokens"])
        )
        if not sound:
            raise ValueError(f"{path}: not a lower-casing BPE of words with marked ends")

    def _ask(self, model, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for at in range(0, len(texts), 20_000) for e in model.encode_batch_fast(texts[at : at + 20_000], add_special_tokens=False)]

    def _spelt(self, words: list[bytes]) -> str:
        """Words in the letters that stand for their UTF-8 bytes, between blanks."""
        return b" ".join(words).decode("latin-1").encode().decode("latin-1").translate(self.letters)

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words, lower-cased and in Latin-1, in a row, and their numbers."""
        blocks = [words[at : at + self.JOINED] for at in range(0, len(words), self.JOINED)]
        ids, size = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for block, got in zip(blocks, self._ask(self.bare, [self._spelt(b) for b in blocks]), strict=True):
            stops = np.flatnonzero(self.last[got]) + 1
            if len(stops) == len(block) and stops[-1] == len(got):
                ids.append(got)
                size.append(np.diff(stops, prepend=0))
            else:
                one_by_one = self._ask(self.inner, [w.decode("latin-1") for w in block])
                ids += one_by_one
                size.append(np.fromiter(map(len, one_by_one), np.int64))
        return np.concatenate(ids), np.concatenate(size)

    def learn_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new runs between blanks, in a row, and their numbers."""
        ids = self._ask(self.inner, runs)
        return np.concatenate(ids), np.fromiter(map(len, ids), np.int64)

    def _latin(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw, first = latin(texts)
        raw = self.lower[raw]
        start, end = cut(raw, first, self.kinds, keep_blanks=False, whole_numbers=False)
        ids, stops = self.words.gather(raw, start, end, self.learn)
        return ids, np.concatenate([[0], stops])[np.searchsorted(start, np.append(first, len(raw)))]

    def _other(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [[r for r in self.blank.split(t) if r] for t in texts]
        ids, stops = self.pool.gather(chain.from_iterable(split), self.learn_runs)
        return ids, np.concatenate([[0], stops])[np.cumsum([0, *map(len, split)])]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null texts have none."""
        return by_script(texts, self.added, self._latin, self._other, self.dtype)


@lru_cache(maxsize=2)
def load(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_records(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, append `end_id` and write `path`/data in ascending id order; then `path`/index.

    Null texts have the end id only. Rows with a null id come first; rows that
    share an id follow each other in an order that isn't fixed between equal
    texts. The index has a row for each record: file, id, offset, length,
    n_tokens and ids_crc32; it is made from the files as they were written.
    """
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        model = load(vocabulary)
        end = np.array([end_id], model.dtype).tobytes()
        chunk, room = [], CHUNK
        for batch in batches:
            ids, texts, full = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for doc, got in zip(ids, model.encode(texts), strict=True):
                chunk.append(record(doc, got.tobytes() + end, model.wide))
                room -= len(chunk[-1])
                if room <= 0:
                    full.append(b"\n".join(chunk))
                    chunk, room = [], CHUNK
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.binary())], ["chunk"])
        if chunk:
            yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(chunk)], pa.binary())], ["chunk"])

    ordered = read.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    chunks = ordered.mapInArrow(run, "chunk binary").select(F.col("chunk").cast("string").alias("value"))
    chunks.write.option("maxRecordsPerFile", CHUNKS).text(f"{path}/data", compression="none")
    scan(docs.sparkSession, path).write.parquet(f"{path}/index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data").select("path", "content")


INDEX = "file string, doc_id long, offset long, length long, n_tokens long, ids_crc32 long"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Read every record of `path`/data and check it: (file, doc_id, offset, length, n_tokens, ids_crc32)."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(name.rpartition("/")[2], doc, at, size, len(ids), zlib.crc32(ids)) for at, size, doc, ids in records(data.as_buffer())]
                columns = zip(*rows, strict=True) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), *[pa.int64()] * 5], strict=True)], ["file", "doc_id", "offset", "length", "n_tokens", "ids_crc32"])

    return _files(spark, path).mapInArrow(run, INDEX)


def file_order(file: Column) -> Column:
    """(partition, file of the partition) by number: as text, names go wrong from the hundred thousandth partition on."""
    return F.struct(F.regexp_extract(file, r"^part-(\d+)", 1).cast("long").alias("part"), F.coalesce(F.try_to_number(F.regexp_extract(file, r"-c(\d+)", 1), F.lit("999999999")), F.lit(0)).cast("long").alias("piece"))


def positions(spark: SparkSession, path: str) -> DataFrame:
    """The index with `start`: the tokens of all records before, in the order of the files. Files, not records, are numbered in one window."""
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    per_file = index.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    order = Window.orderBy(file_order(F.col("file"))).rowsBetween(Window.unboundedPreceding, -1)
    per_file = per_file.select("file", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))
    within = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    out = index.join(per_file, "file").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return out.drop("base")


def shuffled(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    """All records in an order drawn by `seed`: (position, doc_id, ids as little-endian unsigned 32-bit numbers).

    Positions come from the index alone; every file is then read once, each
    record from its offset, and only the ids move to their places.
    """
    place = spark.read.schema(INDEX).parquet(f"{path}/index").select("file", "offset", F.xxhash64("file", "offset", F.lit(seed)).alias("position"))
    wanted = place.groupBy("file").agg(F.collect_list(F.struct("offset", "position")).alias("places"))
    files = _files(spark, path).withColumn("file", F.element_at(F.split("path", "/"), -1)).join(wanted, "file").select("content", "places")

    def run(batches):
        for batch in batches:
            for data, places in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                raw = data.as_buffer()
                for p in places:
                    _, _, doc, ids = next(records(raw, p["offset"]))
                    yield pa.RecordBatch.from_arrays([pa.array([p["position"]], pa.int64()), pa.array([doc], pa.int64()), pa.array([ids.tobytes()], pa.binary())], ["position", "doc_id", "ids"])

    return files.mapInArrow(run, "position long, doc_id long, ids binary").orderBy("position")
