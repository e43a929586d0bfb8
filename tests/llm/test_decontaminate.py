"""The index of item windows against plain search, and its size."""

import random

import pytest

from mosaica.llm import decontaminate


def brute(items, text, window):
    doc = decontaminate.words(text)
    hit, found = [False] * len(doc), set()
    for name, item in items:
        w = decontaminate.words(item)
        cuts = [w[k : k + window] for k in range(max(1, len(w) - window + 1))] if w else []
        for c in cuts:
            for k in range(len(doc) - len(c) + 1):
                if doc[k : k + len(c)] == c:
                    found.add(str(name))
                    hit[k : k + len(c)] = [True] * len(c)
    return hit, found


@pytest.mark.parametrize("window", [1, 2, 3, 7, 10])
def test_index_matches_plain_search(window):
    r = random.Random(window)
    vocab = "a b c d é ff".split()
    line = lambda n: " ".join(r.choices(vocab, k=n))
    items = [(k, line(r.randint(0, 25))) for k in range(40)] + [(98, None), (99, "...")]
    index = decontaminate.Index(items, window)
    for _ in range(60):
        pieces = [line(r.randint(0, 12)), r.choice(items)[1] or "", line(r.randint(0, 12)), (r.choice(items)[1] or "")[: r.randint(0, 40)]]
        text = ", ".join(pieces)
        hit, found = index.scan(decontaminate.words(text))
        want, names = brute(items, text, window)
        assert found == names and (hit is None and not any(want) or hit.tolist() == want)


def test_index_grows_with_the_words_of_items_not_of_windows():
    r = random.Random(3)
    vocab = ["".join(r.choices("abcdefghij", k=6)) for _ in range(5_000)]
    items = [(k, " ".join(r.choices(vocab, k=200))) for k in range(500)]
    index = decontaminate.Index(items)
    stats = index.machine.get_stats()
    assert stats["nodes_count"] <= 100_001 and stats["total_size"] < 20 << 20
    assert len(index.hash) <= 500 * 191


def test_colliding_hashes_are_told_apart(monkeypatch):
    items = [(1, "a b c d"), (2, "b c d e")]
    seen = []
    plain = decontaminate.Index._hashes

    def weak(self, text, start, size):
        seen.append(self.salt)
        h = plain(self, text, start, size)
        return h * 0 if self.salt == 0 else h

    monkeypatch.setattr(decontaminate.Index, "_hashes", weak)
    index = decontaminate.Index(items, 2)
    assert index.salt == 1 and index.scan([b"c", b"d", b"e"]) [1] == {"1", "2"}
