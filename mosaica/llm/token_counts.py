"""Number of unigram tokens of a text, without making the tokens.

An Aho-Corasick automaton over the vocabulary lists all pieces that end at each
place; dynamic programming over places carries the best score and the number of
pieces on its path. Ties follow the tokenizers library's unigram model: a path
replaces another only if it scores strictly more, and paths into a place are
tried from the earliest start. A character that no single piece covers costs
ten less than the worst piece and counts as its UTF-8 bytes.

Where all scores are whole numbers, sums are exact, and since no piece reaches
over the start of a run of blanks, a text's count is the sum over its words;
these are kept. With other scores the whole text is one lattice.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaica.llm.bpe import slices
from mosaica.llm.pool import Pool

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
#: Kinds of pieces in the model file.
NORMAL, USER_DEFINED = 1, 4
#: Words whose counts a worker keeps at most.
MAX_CACHED = 600_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _fields(data: bytes):
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        else:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def read_pieces(path: str, kinds: tuple[int, ...] = (NORMAL,)) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model file, in order of their ids: by default those that can stand for text.

    Control pieces, the unknown piece, byte pieces and unused ones are never
    matched in a text; user-defined pieces, which follow a rule of their own, are
    an error.
    """
    with open(path, "rb") as f:
        data = f.read()
    out = []
    for field, value in _fields(data):
        if field == 1:
            own = dict(_fields(value))
            kind = own.get(3, NORMAL)
            if kind == USER_DEFINED:
                raise ValueError(f"{path}: user-defined pieces are not supported")
            if kind in kinds:
                out.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0))
    return out


class UnigramCounter:
    """Counts tokens of the unigram model over `pieces`, with byte fallback; blanks are written as U+2581 and one is put before a text."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        self.machine = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        whole = all(float(s).is_integer() and abs(s) < 2**40 for _, s in pieces)
        cross = any(BLANK in p.lstrip(BLANK) for p, _ in pieces)
        self.by_word = whole and not cross
        lines = any("\n" in p for p, _ in pieces)
        self.cut = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+" if lines else f"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+").findall
        self.cache: dict[str, int] = {}

    def lattice(self, text: str) -> int:
        """The count of a piece of normalised text by the full dynamic programme."""
        n = len(text)
        best, count = [None] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        ends: dict[int, list] = {}
        for end, found in self.machine.iter(text):
            ends.setdefault(end + 1, []).append(found)
        for at in range(1, n + 1):
            single, top, c = False, None, 0
            for size, score in sorted(ends.get(at, ()), reverse=True):
                single |= size == 1
                s = best[at - size] + score
                if top is None or s > top:
                    top, c = s, count[at - size] + 1
            if not single:
                s = best[at - 1] + self.unknown
                if top is None or s > top:
                    top, c = s, count[at - 1] + len(text[at - 1].encode())
            best[at], count[at] = top, c
        return count[n]

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; null and empty texts have none."""
        norm = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
        if not self.by_word:
            return [self.lattice(t) if t else 0 for t in norm]
        cache = self.cache
        words = [self.cut(t) for t in norm]
        met: set[str] = set()
        for w in words:
            met.update(w)
        fresh = list(met.difference(cache))
        for w in fresh:
            cache[w] = self.lattice(w)
        out = [sum(map(cache.__getitem__, w)) for w in words]
        for w in fresh[max(0, len(fresh) - max(0, len(cache) - MAX_CACHED)) :]:
            del cache[w]
        return out


@lru_cache(maxsize=2)
def load(path: str) -> UnigramCounter:
    return UnigramCounter(read_pieces(path))


def count_column(path: str, text: str | Column) -> Column:
    """A column with the number of tokens of each whole text (null: 0), by the pieces and scores of the file at `path`."""

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load(path)
        for column in batches:
            texts = column.to_pylist()
            yield pa.array([n for a, b in slices(texts, 1_000_000) for n in model.counts(texts[a:b])], pa.int64())

    return counted(text)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, n_chars and n_tokens of the whole text (null: 0), as `count_column` has them."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col), F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n_chars"), count_column(path, text).alias("n_tokens"))
