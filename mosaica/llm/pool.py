"""Ids of the distinct words that a worker meets, held in arrays; and the cutting of texts into words, many at a time."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Iterator
from itertools import islice

import numpy as np

from mosaica.llm.minhash import _BASE, _BYTE, _INVERSE, _powers, mix

#: Characters that are encoded at once.
SLICE = 500_000
#: Words that are looked up at once.
WORDS = 200_000
BLANK, LETTER, NUMBER, OTHER = range(4)


def sections(text: str, most: int = 1 << 21) -> Iterator[str]:
    """Parts of a long text, cut before single blanks between words: there every pattern in use begins a word."""
    at = 0
    while len(text) - at > most:
        k = text.find(" ", at + most)
        while k >= 0 and (k + 1 >= len(text) or text[k - 1].isspace() or text[k + 1].isspace()):
            k = text.find(" ", k + 1)
        if k < 0:
            break
        yield text[at:k]
        at = k
    yield text[at:]


def in_slices(texts: list[str | None], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype: str) -> list[np.ndarray]:
    """The ids of each text (null: none). `encode` gives those of some texts in a row and where each begins and the last ends; it gets about SLICE characters at a time."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    owner, held, room = [], [], SLICE

    def flush() -> None:
        nonlocal owner, held, room
        ids, edges = encode(held)
        at = edges.tolist()
        for k, a, b in zip(owner, at, at[1:], strict=False):
            out[k].append(ids[a:b])
        owner, held, room = [], [], SLICE

    for k, text in enumerate(texts):
        for part in sections(text) if text else ():
            owner.append(k)
            held.append(part)
            room -= len(part)
            if room <= 0:
                flush()
    if held:
        flush()
    none = np.zeros(0, dtype)
    return [x[0] if len(x) == 1 else np.concatenate(x) if x else none for x in out]


def latin(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts in Latin-1 in a row, and where each begins; other texts are an error."""
    raw = [t.encode("latin-1") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])[:-1]


def cut(raw: np.ndarray, first: np.ndarray, kinds: np.ndarray, keep_blanks: bool, whole_numbers: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts in Latin-1 begin and end.

    `raw`: bytes of the texts in a row, which begin at `first`; `kinds`: the
    kind of each byte. Words are runs of letters, of other marks, and of
    numbers or, without `whole_numbers`, single ones; 's 't 'm 'd 're 've 'll
    are words where an apostrophe alone stands before a run that begins so.
    With `keep_blanks` blanks are words too: before a word, the last of a run
    goes to it if it is a space, or stands alone; others stay together.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = kinds[raw]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    if not whole_numbers:
        new |= kind == NUMBER
    new[first[first < n]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    kind = kind[start]
    opens = np.zeros(len(start), bool)  # the first run of a text
    opens[np.searchsorted(start, first[first < n])] = True
    follows = np.append(~opens[1:], False)  # a run of the same text comes after
    lone = (kind == OTHER) & (end - start == 1) & (raw[start] == 39) & follows
    after_space = np.zeros(len(start), bool)
    if keep_blanks:
        last = raw[end - 1] == 32
        after_space[1:] = ((kind == BLANK) & last & follows)[:-1]
        lone &= ~after_space
    mark = np.flatnonzero(lone)
    mark = mark[kind[mark + 1] == LETTER]
    one, size = raw[start[mark + 1]], (end - start)[mark + 1]
    two = np.where(size > 1, raw[np.minimum(start[mark + 1] + 1, n - 1)], 0)
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
    taken = short + 2 * long
    end[mark] += taken
    start[mark + 1] += taken
    if not keep_blanks:
        keep = (kind != BLANK) & (end > start)
        return start[keep], end[keep]
    before = (kind == BLANK) & follows
    rest = np.stack([start, np.where(before, end - 1, end)], 1)  # what stays of a run of blanks, and other words
    rest[after_space, 0] -= 1
    alone = np.stack([end - 1, end], 1)
    both = np.stack([rest, alone], 1).reshape(-1, 2)
    keep = np.stack([rest[:, 1] > rest[:, 0], before & (raw[np.maximum(end - 1, 0)] != 32)], 1).reshape(-1)
    return both[keep, 0], both[keep, 1]


class Words:
    """Ids of words given as stretches of bytes: found by hash, confirmed by their bytes.

    Beyond `room` words the half that is used most stays, with its counts
    halved; others are learnt again when met again.
    """

    def __init__(self, dtype: str, room: int) -> None:
        self.room = room
        self.bits = max(8, int(2 * room).bit_length() + 1)
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.hash = np.zeros(0, np.uint64)
        self.bytes, self.first, self.length = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.start, self.size = np.zeros(0, dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The number of the word with each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        on, at = np.arange(len(h)), (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(on):
            got = self.slot[at]
            there = got >= 0
            on, at, got = on[there], at[there], got[there]
            same = self.hash[got] == h[on]
            out[on[same]] = got[same]
            on, at = on[~same], (at[~same] + 1) & ((1 << self.bits) - 1)
        return out

    def _place(self, numbers: np.ndarray) -> None:
        """Enter words, whose hashes are known and distinct."""
        at = (self.hash[numbers] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(numbers):
            free = self.slot[at] < 0
            self.slot[at[free]] = numbers[free]
            left = self.slot[at] != numbers
            numbers, at = numbers[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def gather(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words raw[start:end] in a row, and where those of each end. `learn` gives ids in a row and their numbers for new words."""
        ids, stops, base = [self.ids[:0]], [np.zeros(0, np.int64)], 0
        for k in range(0, len(start), WORDS):
            got, ends = self._gather(raw, start[k : k + WORDS], end[k : k + WORDS], learn)
            ids.append(got)
            stops.append(ends + base)
            base += len(got)
        return np.concatenate(ids), np.concatenate(stops)

    def _gather(self, raw, start, end, learn):
        low, high = int(start[0]), int(end[-1])
        raw, start, end = raw[low:high], start - low, end - low
        length = end - start
        with np.errstate(over="ignore"):
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_BYTE[raw] * _powers(_BASE, len(raw)), out=sums[1:])
            h = mix((sums[end] - sums[start]) * _powers(_INVERSE, len(raw))[start] + length.astype(np.uint64))
        at = self._find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            hashes, which, back = np.unique(h[new], return_index=True, return_inverse=True)
            at[new] = self._learn(raw, start[new[which]], end[new[which]], hashes, learn)[back]
        self.uses += np.bincount(at, minlength=len(self.uses))
        # the bytes decide: a word whose hash is another's is learnt for itself
        stops = np.cumsum(length)
        place = np.arange(stops[-1]) - np.repeat(stops - length, length)
        wrong = self.length[at] != length
        differ = self.bytes[np.minimum(np.repeat(self.first[at], length) + place, len(self.bytes) - 1)] != raw[np.repeat(start, length) + place]
        if differ.any():
            wrong |= np.add.reduceat(differ, stops - length) > 0
        size = self.size[at]
        if wrong.any():
            own = np.flatnonzero(wrong)
            extra, n = learn([raw[a:b].tobytes() for a, b in zip(start[own].tolist(), end[own].tolist(), strict=True)])
            size[own] = n
        stops = np.cumsum(size)
        src = np.repeat(self.start[at] - stops + size, size) + np.arange(stops[-1])
        ids = self.ids[np.minimum(src, len(self.ids) - 1)]
        if wrong.any():
            ids[np.repeat(wrong, size)] = extra
        if len(self.hash) > self.room:
            self._shrink()
        return ids, stops

    def _learn(self, raw, start, end, hashes, learn) -> np.ndarray:
        words = [raw[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        ids, size = learn(words)
        length = end - start
        numbers = len(self.hash) + np.arange(len(words))
        self.hash = np.concatenate([self.hash, hashes])
        self.first = np.concatenate([self.first, len(self.bytes) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(words), np.uint8)])
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])
        while len(self.hash) * 2 > len(self.slot):
            self.bits += 1
            self.slot = np.full(1 << self.bits, -1, np.int32)
            self._place(np.arange(numbers[0]))
        self._place(numbers)
        return numbers

    def _shrink(self) -> None:
        keep = np.sort(np.argpartition(-self.uses, self.room // 2)[: self.room // 2])

        def compact(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            start, size = start[keep], size[keep]
            at = np.cumsum(size) - size
            return pool[np.repeat(start - at, size) + np.arange(size.sum())], at, size

        self.bytes, self.first, self.length = compact(self.bytes, self.first, self.length)
        self.ids, self.start, self.size = compact(self.ids, self.start, self.size)
        self.hash, self.uses = self.hash[keep], self.uses[keep] // 2
        self.slot[:] = -1
        self._place(np.arange(len(keep)))


class _Places(dict):
    """Numbers strings in the order in which they are first asked for."""

    def __missing__(self, key: Hashable) -> int:
        self[key] = n = len(self)
        return n


class Pool:
    """The same for strings that are Python objects: what is not Latin-1."""

    def __init__(self, dtype: str, room: int) -> None:
        self.room = room
        self.place = _Places()
        self.ids = np.zeros(0, dtype)
        self.start, self.size, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def gather(self, strings: Iterable[Hashable], learn: Callable[[list], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all strings in a row, and where those of each end. `learn` gives ids in a row and their numbers for a list of new strings."""
        known = len(self.start)
        at = np.fromiter(map(self.place.__getitem__, strings), np.int64)
        if len(self.place) > known:
            ids, size = learn(list(islice(reversed(self.place), len(self.place) - known))[::-1])
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.uses = np.concatenate([self.uses, np.zeros(len(size), np.int64)])
            self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])
        self.uses += np.bincount(at, minlength=len(self.uses))
        size = self.size[at]
        stops = np.cumsum(size)
        out = self.ids[np.repeat(self.start[at] - stops + size, size) + np.arange(stops[-1] if len(stops) else 0)]
        if len(self.place) > self.room:
            self._shrink()
        return out, stops

    def _shrink(self) -> None:
        keep = np.sort(np.argpartition(-self.uses, self.room // 2)[: self.room // 2])
        names = list(self.place)
        size = self.size[keep]
        start = np.cumsum(size) - size
        self.ids = self.ids[np.repeat(self.start[keep] - start, size) + np.arange(size.sum())]
        self.place = _Places((names[k], n) for n, k in enumerate(keep.tolist()))
        self.start, self.size, self.uses = start, size, self.uses[keep] // 2
