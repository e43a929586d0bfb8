"""Test passages in documents, found with an Aho-Corasick automaton over words.

An item's windows are its runs of ten words. Each holds one of the pieces of
five words that begin at every fifth word of the item, so an automaton over
these pieces, one path for each word of an item, finds all places where a window
can be; it reads every document once. There the window's hash is looked up, and
its words are compared. Words are matched in UTF-8: all separators are ASCII, so
a byte table normalises. Spans are mapped back to the original text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaica.llm.minhash import _BASE, _INVERSE, _powers, mix

WINDOW = 10
#: Words of the items of one automaton, which bounds its nodes; more items take more automata.
GROUP_WORDS = 1_000_000
#: Automata that a worker keeps; if there are more, each batch of documents builds one after another.
KEPT = 2

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b in _SEPARATORS else b for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, lower-cased in A-Z."""
    return text.encode().translate(_TABLE).split() if text else []


class Index:
    """The windows of some items: the automaton of their pieces, and for each different window its words and the items that have it."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW) -> None:
        self.window, self.piece = window, (window + 1) // 2
        self.names = [str(i) for i, _ in items]
        self.codes: dict[bytes, int] = {}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        texts, start, size, owner, at = [], [], [], [], 0
        for k, (_, text) in enumerate(items):
            w = [self.codes.setdefault(x, len(self.codes) + 1) for x in words(text)]
            if not w:
                continue
            if len(w) < window:
                self.machine.add_word(tuple(w))
            else:
                for p in range(0, len(w) - self.piece + 1, self.piece):
                    self.machine.add_word(tuple(w[p : p + self.piece]))
            n = max(1, len(w) - window + 1)
            texts.append(np.array(w, np.int64))
            start.append(at + np.arange(n))
            size.append(np.full(n, min(window, len(w))))
            owner.append(np.full(n, k))
            at += len(w)
        self.empty = not texts
        if self.empty:
            return
        self.machine.make_automaton()
        self.text = np.concatenate(texts)
        start, size, owner = np.concatenate(start), np.concatenate(size), np.concatenate(owner)
        self.salt = 0
        while True:
            h = self._hashes(self.text, start, size)
            self.hash, first, back = np.unique(h, return_index=True, return_inverse=True)
            self.start, self.size = start[first], size[first]
            if self._same(self.text, start, size, back).all():
                break
            self.salt += 1  # two windows have one hash: others are tried
        pairs = np.unique(np.stack([back, owner], 1), axis=0)
        self.owners, self.first_owner = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.hash) + 1))
        self.short = np.unique(self.size[self.size < window])

    def _hashes(self, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            sums = np.zeros(len(text) + 1, np.uint64)
            np.cumsum(mix(text.astype(np.uint64) + np.uint64(self.salt << 40)) * _powers(_BASE, len(text)), out=sums[1:])
            return mix((sums[start + size] - sums[start]) * _powers(_INVERSE, len(text))[start] + size.astype(np.uint64))

    def _same(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Whether the words text[start:start + size] are those of the window with that number."""
        out = self.size[number] == size
        for k in range(self.window):
            inside = out & (k < size)
            out[inside] = text[start[inside] + k] == self.text[self.start[number[inside]] + k]
        return out

    def scan(self, found: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Which words of a document are hit (None: no word), and the items that occur."""
        if self.empty or not found:
            return None, set()
        ids = tuple(map(self.codes.get, found, repeat(0)))
        ends = list(self.machine.iter(ids))
        if not ends:
            return None, set()
        end, length = np.array(ends, np.int64).T
        begin = end + 1 - length
        # a piece is one of the first places of its window; an item of fewer words than a window is found as a whole
        long = length == self.piece
        start = (begin[long][:, None] - np.arange(self.piece)).reshape(-1)
        size = np.full(len(start), self.window)
        few = np.isin(length, self.short)
        start, size = np.concatenate([start, begin[few]]), np.concatenate([size, length[few]])
        fits = (start >= 0) & (start + size <= len(ids))
        start, size = np.unique(np.stack([start[fits], size[fits]]), axis=1)
        if not len(start):
            return None, set()
        low, high = int(start.min()), int((start + size).max())
        part, start = np.array(ids[low:high], np.int64), start - low
        h = self._hashes(part, start, size)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        got = self.hash[at] == h
        start, size, at = start[got], size[got], at[got]
        got = self._same(part, start, size, at)
        start, size, at = start[got] + low, size[got], at[got]
        if not len(start):
            return None, set()
        step = np.zeros(len(ids) + 1, np.int64)
        np.add.at(step, start, 1)
        np.add.at(step, start + size, -1)
        items: set[str] = set()
        for n in np.unique(at).tolist():
            items.update(self.names[k] for k in self.owners[self.first_owner[n] : self.first_owner[n + 1]].tolist())
        return np.cumsum(step[:-1]) > 0, items


def spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character ranges of the original text that runs of hit words cover."""
    raw = text.encode()
    part = np.frombuffer(raw.translate(_TABLE), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], part.view(np.int8), [0]])))
    char = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])  # characters before each byte
    starts, ends = char[edge[0::2]], char[edge[1::2]]
    run = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return [(int(starts[a]), int(ends[b - 1])) for a, b in zip(run[0::2], run[1::2], strict=True)]


RESULT = "n_words long, n_hit long, item_ids array<string>, hit_spans array<struct<start:int,end:int>>"


def hits_column(spark: SparkSession, text: str | Column, items: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> Column:
    """A column of structs: n_words, n_hit, item_ids (sorted as strings) and hit_spans of each text.

    A window is `window` consecutive words of an item; an item of fewer words,
    but not none, is one window. Null texts have no words; null item ids are
    left out. Items are the test questions: driver and workers hold their texts
    once. Automata are built for GROUP_WORDS words of items each; a worker keeps
    KEPT of them, and if there are more, builds them one after another for each
    batch of documents, so that its memory has a bound whatever their number.
    """
    groups: list[list] = [[]]
    room = GROUP_WORDS
    for r in items.select(item_id, item_text).where(F.col(item_id).isNotNull()).toLocalIterator():
        cost = len(words(r[1]))
        if cost > room and groups[-1]:
            groups.append([])
            room = GROUP_WORDS
        groups[-1].append((r[0], r[1]))
        room -= cost
    shared = spark.sparkContext.broadcast(groups)
    token = uuid.uuid4().hex

    @F.pandas_udf(RESULT)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            texts = [text if isinstance(text, str) else None for text in column]
            sizes: list[int] = [0] * len(texts)
            masks: list[np.ndarray | None] = [None] * len(texts)
            items: list[set[str]] = [set() for _ in texts]
            for index in indexes(token, shared.value, window):
                for k, text in enumerate(texts):  # words of one text at a time: those of a batch would be most of a worker's memory
                    w = words(text)
                    sizes[k] = len(w)
                    hit, own = index.scan(w)
                    if hit is not None:
                        masks[k] = hit if masks[k] is None else masks[k] | hit
                        items[k] |= own
            rows = []
            for text, n, mask, own in zip(texts, sizes, masks, items, strict=True):
                at = [] if mask is None else [{"start": a, "end": b} for a, b in spans(text, mask)]
                rows.append((n, 0 if mask is None else int(mask.sum()), sorted(own), at))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "item_ids", "hit_spans"])

    return found(text)


_KEPT: dict[tuple[str, int], list[Index]] = {}


def indexes(token: str, groups: list[list], window: int) -> Iterator[Index]:
    """The index of each group of items: kept by the worker under `token` if there are few, else built anew."""
    if len(groups) > KEPT:
        yield from (Index(g, window) for g in groups)
        return
    if (token, window) not in _KEPT:
        _KEPT.clear()
        _KEPT[token, window] = [Index(g, window) for g in groups]
    yield from _KEPT[token, window]


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per row of `docs`: id, n_words, n_hit, item_ids and hit_spans, as `hits_column` has them."""
    got = docs.select(F.col(id_col), hits_column(docs.sparkSession, F.col(text_col), items, **how).alias("__hit"))
    return got.select(id_col, "__hit.*")


ORACLE = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
p AS (
  SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS k FROM b WHERE len(w) > 0),
win AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, k, k + 9), ' ') AS s FROM p),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
pl AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS k, w FROM d, sizes WHERE len(w) >= n),
got AS (
  SELECT pl.doc_id, pl.k, pl.n, win.item_id
  FROM (SELECT doc_id, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS s FROM pl) pl
  JOIN win ON pl.s = win.s AND pl.n = win.n),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS i FROM got) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM got) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
