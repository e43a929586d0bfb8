"""Byte-level BPE by speculation.

For each distinct word a greedy longest match proposes tokens, all words of a
batch at once on an array trie. A sequence of tokens is what merging gives if
every adjacent pair is: merging the bytes of the two gives just those two. All
adjacent pairs are tested together; only words with a failing pair, or with a
token that merging cannot make, are merged exactly: first around the failing
places, which the same test then confirms, and over a wider stretch, in the end
the whole word, where it does not.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaica.llm.pool import BLANK, LETTER, NUMBER, OTHER, Pool, Words, cut, in_slices, latin

#: Words whose ids a worker keeps at most; others are encoded again when met.
MAX_CACHED = 600_000
#: Likewise for tested pairs of tokens.
MAX_CACHED_PAIRS = 200_000
#: Tokens on either side of a failing place that are merged again at first.
REACH = 3
#: Bytes from which on the two ways to do the same are by place instead of by row: longest matches, and exact merging.
LONG = 128


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies, inverted."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_kinds() -> np.ndarray:
    """The kind of each letter of Latin-1, as the patterns of the vocabularies see it."""
    kinds = np.full(256, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        kinds[[c for c in range(256) if regex.fullmatch(pattern, chr(c))]] = kind
    return kinds


class ByteBPE:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library.

    Supports what byte-level BPE files of this kind use: no normaliser, the
    byte-level pre-tokeniser with its own pattern, merges without dropout,
    unknown tokens or affixes, and added tokens that are matched verbatim.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["dropout"] or model["end_of_word_suffix"] or model["continuing_subword_prefix"] or model.get("ignore_merges"):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        letters = byte_letters()
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items() if all(c in letters for c in t)}
        ids = {b: i for i, b in self.bytes_of.items()}
        self.base = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        self.size = max(self.bytes_of) + 1
        pairs, ranks, made = [], [], []
        parts: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y = model["vocab"][a], model["vocab"][b]
            z = model["vocab"][a + b]
            pairs.append(x * self.size + y)
            ranks.append(rank)
            made.append(z)
            parts.setdefault(z, (x, y))
        order = np.argsort(np.array(pairs, np.int64), kind="stable")
        self.pairs, self.ranks, self.made = np.array(pairs, np.int64)[order], np.array(ranks, np.int64)[order], np.array(made, np.int64)[order]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that look around are not supported")
        self.added_bytes = {i: t.encode() for t, i in self.added.items()}
        self.split = regex.compile(self.PATTERN)
        self.kinds = byte_kinds()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words, self.pool = Words("<u4", MAX_CACHED), Pool("<u4", MAX_CACHED)
        self.pairs_seen: dict[int, bool] = {}
        self._trie(ids)
        shown = [self.bytes_of.get(i, self.added_bytes.get(i, b"")) for i in range(max([self.size - 1, *self.added_bytes]) + 1)]
        self.token_bytes, self.token_size = np.frombuffer(b"".join(shown), np.uint8), np.fromiter(map(len, shown), np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.rule = {p: (r, m) for p, r, m in zip(self.pairs.tolist(), self.ranks.tolist(), self.made.tolist(), strict=True)}
        # tokens that merging their own bytes gives back: only those can stand in a result
        tokens = [b for b in ids]
        self.firm = np.zeros(self.size, bool)
        for at in range(0, len(tokens), 20_000):
            some = tokens[at : at + 20_000]
            for w, got in zip(some, self.merge(some), strict=True):
                self.firm[ids[w]] = len(got) == 1 and got[0] == ids[w]

    def _trie(self, ids: dict[bytes, int]) -> None:
        nodes: dict[bytes, int] = {b"": 0}
        for t in ids:
            for k in range(1, len(t) + 1):
                nodes.setdefault(t[:k], len(nodes))
        code = np.array([nodes[t[:-1]] * 256 + t[-1] for t in nodes if t], np.int64)
        order = np.argsort(code)
        self.edge, self.child = code[order], np.array([n for t, n in nodes.items() if t], np.int32)[order]
        self.token = np.array([ids.get(t, -1) for t in nodes], np.int32)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the merge table of each pair, and whether it is there."""
        code = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        return at, self.pairs[at] == code

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Exact merging: each word applies its lowest-ranked merge everywhere, from the left, until none is left."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        by_size = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(by_size):
            longest = max(len(words[by_size[at]]), 8)
            if longest > LONG:
                out[by_size[at]] = self._merge_queue(words[by_size[at]])
                at += 1
                continue
            some = [by_size[at]]
            at += 1
            while at < len(by_size) and len(words[by_size[at]]) <= 2 * longest and len(some) < max(1, 500_000 // (2 * longest)):
                some.append(by_size[at])
                at += 1
            for i, got in zip(some, self._merge_block([words[i] for i in some]), strict=True):
                out[i] = got
        return out

    def _merge_queue(self, word: bytes) -> np.ndarray:
        """One long word, with a queue of its pairs by rank and place: n log n in its bytes."""
        rule = self.rule
        ids = self.base[np.frombuffer(word, np.uint8)].tolist()
        n, size = len(ids), self.size
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(*r, k, x, y) for k, (x, y) in enumerate(zip(ids, ids[1:], strict=False)) if (r := rule.get(x * size + y))]
        heapq.heapify(queue)
        while queue:
            _, made, k, x, y = heapq.heappop(queue)
            right = after[k]
            if ids[k] != x or right >= n or ids[right] != y:
                continue  # one of the two has merged with another since
            ids[k], ids[right] = made, -1
            far = after[k] = after[right]
            if far < n:
                before[far] = k
                if r := rule.get(made * size + ids[far]):
                    heapq.heappush(queue, (*r, k, made, ids[far]))
            left = before[k]
            if left >= 0 and (r := rule.get(ids[left] * size + made)):
                heapq.heappush(queue, (*r, left, ids[left], made))
        return np.array([i for i in ids if i >= 0], np.int64)

    def _merge_block(self, words: list[bytes]) -> list[np.ndarray]:
        n, width = len(words), max(map(len, words), default=0)
        if not width:
            return [np.zeros(0, np.int64)] * n
        grid = np.full((n, width), -1, np.int64)
        size = np.array([len(w) for w in words])
        grid[np.arange(width) < size[:, None]] = self.base[np.frombuffer(b"".join(words), np.uint8)]
        far = len(self.pairs) + 1
        live = np.arange(n)
        while len(live) and grid.shape[1] > 1:
            g = grid[live]
            a, b = g[:, :-1], g[:, 1:]
            at, ok = self._lookup(a, b)
            rank = np.where(ok & (b >= 0) & (a >= 0), self.ranks[at], far)
            least = rank.min(1)
            go = least < far
            live, g, rank, at, least = live[go], g[go], rank[go], at[go], least[go]
            if not len(live):
                break
            hit = rank == least[:, None]
            # of overlapping places (a a a) the left one merges: every second place of a run of hits
            place = np.arange(hit.shape[1])
            run = np.maximum.accumulate(np.where(hit, -1, place), axis=1)
            hit &= (place - run) % 2 == 1
            r, c = np.nonzero(hit)
            g[r, c] = self.made[at[r, c]]
            g[r, c + 1] = -2
            keep = g != -2
            shifted = np.full_like(g, -1)
            rows, cols = np.nonzero(keep)
            first = np.concatenate([[0], np.cumsum(keep.sum(1))])[:-1]
            shifted[rows, np.arange(len(rows)) - first[rows]] = g[rows, cols]
            grid[live] = shifted
            if (grid[:, -1] < 0).all():
                grid = grid[:, : max(1, int((grid >= 0).sum(1).max()))]
        return [row[row >= 0] for row in grid]

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match: the tokens of all words in a row, and the number of each word's."""
        count = np.zeros(len(words), np.int64)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= LONG]
        flat = [np.zeros(0, np.int64)]
        for at in range(0, len(short), 10_000):
            some = short[at : at + 10_000]
            grid, count[some] = self._by_row([words[i] for i in some])
            flat.append(grid[grid >= 0].astype(np.int64))
        tokens = np.concatenate(flat)
        if len(short) < len(words):
            parts = dict(zip(short, np.split(tokens, np.cumsum(count[short])[:-1]), strict=True)) if short else {}
            parts |= {i: self._by_place(w) for i, w in enumerate(words) if len(w) > LONG}
            count[list(parts)] = [len(p) for p in parts.values()]
            tokens = np.concatenate([flat[0], *(parts[i] for i in sorted(parts))])
        return tokens, count

    def _step(self, node: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the trie goes on from each node by a byte, and to where."""
        code = node * 256 + byte
        place = np.minimum(np.searchsorted(self.edge, code), len(self.edge) - 1)
        return self.edge[place] == code, self.child[place]

    def _by_place(self, word: bytes) -> np.ndarray:
        """Longest matches of one long word: found for all places together, then followed from the start."""
        raw = np.concatenate([np.frombuffer(word, np.uint8), np.zeros(1, np.uint8)]).astype(np.int64)
        n = len(word)
        best, end = np.zeros(n, np.int64), np.arange(1, n + 1)
        on, node, depth = np.arange(n), np.zeros(n, np.int64), 0
        while len(on):
            fine, child = self._step(node, raw[on + depth])
            fine &= on + depth < n
            on, node = on[fine], child[fine].astype(np.int64)
            depth += 1
            real = self.token[node] >= 0
            best[on[real]], end[on[real]] = self.token[node[real]], on[real] + depth
            keep = on + depth < n
            on, node = on[keep], node[keep]
        follow, at, taken = end.tolist(), 0, []
        while at < n:
            taken.append(at)
            at = follow[at]
        return best[taken]

    def _by_row(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches of short words, a token of every word at a time: tokens row by row, and their numbers."""
        n, size = len(words), np.array([len(w) for w in words])
        width = int(size.max())
        raw = np.zeros((n, width + 1), np.uint8)
        raw[:, :width][np.arange(width) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        out, count, pos = np.full((n, width), -1, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.arange(n)
        while len(live):
            node, best, end = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64), pos[live].copy()
            at, on = pos[live].copy(), np.arange(len(live))
            while len(on):
                fine, step = self._step(node[on], raw[live[on], at[on]])
                fine &= at[on] < size[live[on]]
                on, step = on[fine], step[fine]
                node[on] = step
                at[on] += 1
                token = self.token[step]
                real = token >= 0
                best[on[real]] = token[real]
                end[on[real]] = at[on[real]]
            out[live, count[live]] = best
            count[live] += 1
            pos[live] = end
            live = live[end < size[live]]
        return out, count

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether merging their joined bytes gives just the two."""
        code = left * self.size + right
        distinct, back = np.unique(code, return_inverse=True)
        known = self.pairs_seen
        if len(known) > MAX_CACHED_PAIRS:
            known.clear()
        fresh = [c for c in distinct.tolist() if c not in known]
        got = self.merge([self.bytes_of[c // self.size] + self.bytes_of[c % self.size] for c in fresh])
        for c, g in zip(fresh, got, strict=True):
            known[c] = len(g) == 2 and g[0] == c // self.size and g[1] == c % self.size
        return np.array([known[c] for c in distinct.tolist()], bool)[back]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the number of each word's, by proposal and test, with exact merging for those that fail."""
        return self._verified(*self.propose(words), REACH)

    def _verified(self, tokens: np.ndarray, count: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """The tokens if they pass the test; else with the words that fail merged again around their failing places and tested again."""
        word = np.repeat(np.arange(len(count)), count)
        bad = ~self.firm[tokens]
        inner = np.flatnonzero(word[1:] == word[:-1])
        torn = inner[~self.compatible(tokens[inner], tokens[inner + 1])]
        bad[torn] = bad[torn + 1] = True
        failing = np.unique(word[bad])
        if not len(failing):
            return tokens, count
        fails = np.zeros(len(count), bool)
        fails[failing] = True
        pick = fails[word]
        got, n = self._merged_around(tokens[pick], count[failing], bad[pick], reach)
        if reach < count[failing].max():  # otherwise whole words were merged, and that is what they are
            got, n = self._verified(got, n, 4 * reach)
        count = count.copy()
        count[failing] = n
        pick_new = fails[np.repeat(np.arange(len(count)), count)]
        out = np.empty(len(pick_new), np.int64)
        out[pick_new], out[~pick_new] = got, tokens[~pick]
        return out, count

    def _merged_around(self, tokens: np.ndarray, count: np.ndarray, bad: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """The tokens with all stretches of `reach` around bad ones, within their words, merged from their bytes."""
        stops = np.cumsum(count)
        word = np.repeat(np.arange(len(count)), count)
        at = np.flatnonzero(bad)
        depth = np.zeros(len(tokens) + 1, np.int64)
        np.add.at(depth, np.maximum(at - reach, (stops - count)[word[at]]), 1)
        np.add.at(depth, np.minimum(at + reach + 1, stops[word[at]]), -1)
        inside = np.cumsum(depth[:-1]) > 0
        opens = inside & ~(np.concatenate([[False], inside[:-1]]) & np.concatenate([[False], word[1:] == word[:-1]]))
        closes = inside & ~(np.concatenate([inside[1:], [False]]) & np.concatenate([word[1:] == word[:-1], [False]]))
        first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        listed = tokens.tolist()
        merged = self.merge([b"".join(map(self.bytes_of.__getitem__, listed[a:b])) for a, b in zip(first.tolist(), last.tolist(), strict=True)])
        edges = np.concatenate([[0], last])
        out = list(chain.from_iterable((tokens[e:a], m) for e, a, m in zip(edges.tolist(), first.tolist(), merged, strict=False)))
        change = np.fromiter(map(len, merged), np.int64, len(merged)) - (last - first)
        return np.concatenate([*out, tokens[edges[-1] :]]), count + np.bincount(word[first], change, len(count)).astype(np.int64)

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words in Latin-1, in a row, and their numbers."""
        return self.encode_words([w if w.isascii() else w.decode("latin-1").encode() for w in words])

    def learn_strings(self, words: list[str | int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of other new words, in a row, and their numbers; an added token is its id."""
        ids, count = self.encode_words([w.encode() if isinstance(w, str) else b"" for w in words])
        tokens = [k for k, w in enumerate(words) if isinstance(w, int)]
        if not tokens:
            return ids, count
        parts = np.split(ids, np.cumsum(count)[:-1])
        for k in tokens:
            parts[k] = np.array([words[k]], np.int64)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def _latin(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw, first = latin(texts)
        start, end = cut(raw, first, self.kinds, keep_blanks=True, whole_numbers=True)
        ids, stops = self.words.gather(raw, start, end, self.learn)
        return ids, np.concatenate([[0], stops])[np.searchsorted(start, np.append(first, len(raw)))]

    def _other(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [self.pieces(t) for t in texts]
        ids, stops = self.pool.gather(chain.from_iterable(split), self.learn_strings)
        return ids, np.concatenate([[0], stops])[np.cumsum([0, *map(len, split)])]

    def pieces(self, text: str) -> list[str | int]:
        """The pre-tokeniser's words, with the ids of added tokens between them."""
        parts = self.cut.split(text) if self.cut else [text]
        return list(chain.from_iterable([self.added[p]] if p in self.added else self.split.findall(p) for p in parts if p))

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit numbers (null: none), as the library gives without special tokens added."""
        return by_script(texts, self.added, self._latin, self._other, "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are not UTF-8 become U+FFFD."""
        size = self.token_size[ids]
        stops = np.cumsum(size)
        at = np.repeat(self.token_start[ids] - stops + size, size) + np.arange(stops[-1] if len(stops) else 0)
        return self.token_bytes[at].tobytes().decode("utf-8", "replace")


def by_script(texts: list[str | None], added: Iterable[str], plain: Callable, other: Callable, dtype: str) -> list[np.ndarray]:
    """The ids of each text: by `plain` if it is in Latin-1 and holds no added token, by `other` if not."""

    def is_plain(text: str) -> bool:
        if any(a in text for a in added):
            return False
        if text.isascii():
            return True
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    mask = [bool(t) and is_plain(t) for t in texts]
    out = in_slices([t if m else None for t, m in zip(texts, mask, strict=True)], plain, dtype)
    if not all(m or not t for t, m in zip(texts, mask, strict=True)):
        rest = in_slices([None if m else t for t, m in zip(texts, mask, strict=True)], other, dtype)
        out = [a if m else b for a, b, m in zip(out, rest, mask, strict=True)]
    return out


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    """The model of a file, kept by each Python worker."""
    return ByteBPE(path)


def slices(texts: list[str | None], chars: int = 2_000_000):
    """Ranges of a batch that hold about `chars` characters each, and one text at least."""
    start = room = 0
    for i, t in enumerate(texts):
        room += len(t or "")
        if room >= chars:
            yield start, i + 1
            start, room = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def ids_column(path: str, text: str | Column, decoded: bool = False) -> Column:
    """A column of structs: ids (little-endian unsigned 32-bit numbers) of each whole text and, if asked for, the text decoded from them.

    `path` names a byte-level BPE file that every executor can read. A null text
    is an empty one.
    """

    @F.arrow_udf("struct<ids: binary, decoded: string>" if decoded else "struct<ids: binary>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load(path)
        for column in batches:
            got = model.encode_batch(column.to_pylist())
            out = {"ids": pa.array([g.tobytes() for g in got], pa.binary())}
            if decoded:
                out["decoded"] = pa.array(map(model.decode, got), pa.string())
            yield pa.StructArray.from_arrays(list(out.values()), list(out))

    return encoded(text)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Per row of `docs`: id, ids and, if asked for, decoded, as `ids_column` has them. Ids of documents do not pass through Python."""
    read = docs.select(F.col(id_col), ids_column(path, F.col(text_col).cast("string"), decoded).alias("__got" if id_col != "__got" else "__got_"))
    return read.select(read.columns[0], f"{read.columns[1]}.*")
