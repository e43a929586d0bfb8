"""Token records: files, their order, shuffled reads, and the encoder against the library."""

import json
import random

import numpy as np
import pytest

from mosaica.llm import common, token_records
from mosaica.llm.queries import BYTE_BPE, WORD_BPE, vocabulary

BIG = 2**60 + 1


def library(texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary(WORD_BPE))
    return [e.ids for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_on_all_pairs_of_latin_letters():
    texts = [f"x{chr(a)}{chr(b)}y" for a in range(256) for b in range(0, 256, 3)]
    assert [g.tolist() for g in token_records.WordEncoder(vocabulary(WORD_BPE)).encode(texts)] == library(texts)


def test_encoder_on_mixed_scripts_with_a_small_pool():
    r = random.Random(5)
    letters = [chr(c) for c in range(256)] + [*"’“漢字́İΣς ", "<|endoftext|>", "'re", "</w>"] + [" "] * 40
    own = token_records.WordEncoder(vocabulary(WORD_BPE))
    own.pool.room = own.words.room = 200
    for _ in range(6):
        texts = [None, "", *("".join(r.choices(letters, k=40)) for _ in range(300))]
        assert [g.tolist() for g in own.encode(texts)] == library(texts)
    assert len(own.pool.place) <= 200 and len(own.words.hash) <= 200


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError, match="marked ends"):
        token_records.WordEncoder(vocabulary(BYTE_BPE))
    with open(vocabulary(WORD_BPE)) as f:
        spec = json.load(f)
    spec["normalizer"]["normalizers"].pop()
    (tmp_path / "cased.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="marked ends"):
        token_records.WordEncoder(str(tmp_path / "cased.json"))


def test_files_are_cut_and_read_in_any_order(spark, monkeypatch):
    monkeypatch.setattr(token_records, "CHUNK", 60)
    monkeypatch.setattr(token_records, "CHUNKS", 2)
    rows = [(BIG + k, f"the text number {k} of many") for k in range(40)] + [(None, "no id"), (-3, None)]
    path = common.fresh_path(spark, "records")
    token_records.write_records(spark.createDataFrame(rows, "doc_id long, text string"), path, vocabulary(WORD_BPE))
    got = sorted(token_records.positions(spark, path).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in order]
    assert [r.start for r in got] == np.cumsum([0, *(len(x) + 1 for x in library([t for _, t in order])[:-1])]).tolist()
    assert len({r.file for r in got}) > 8
    one, two = (token_records.shuffled(spark, path, seed).collect() for seed in (1, 2))
    want = {i: [*x, 1] for (i, t), x in zip(rows, library([t for _, t in rows]), strict=True)}
    for out in (one, two):
        assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in out} == want
    assert [r.doc_id for r in one] != [r.doc_id for r in two]


def test_files_are_ordered_by_number(spark, tmp_path):
    names = [f"part-{k:05d}-x-c000.txt" for k in range(99_990, 100_010)] + [f"part-100010-x-c{k:03d}.txt" for k in range(998, 1003)]
    rows = [(n, k, 0, 10, 2, 7) for k, n in enumerate(names)]
    spark.createDataFrame(rows[::-1], token_records.INDEX).write.parquet(f"{tmp_path}/index")
    got = {r.doc_id: r.start for r in token_records.positions(spark, str(tmp_path)).collect()}
    assert got == {k: 2 * k for k in range(len(names))}


def test_long_texts_are_cut_between_words():
    from mosaica.llm import bpe, pool

    r = random.Random(9)
    letters = [*"abcdefgh", *"    ", "\n", "'s", "'", " \n ", "12", ".", "é", "\t", "\x85"]
    byte, word = bpe.load(vocabulary(BYTE_BPE)), token_records.load(vocabulary(WORD_BPE))
    for _ in range(40):
        text = "".join(r.choices(letters, k=400))
        parts = list(pool.sections(text, 40))
        assert "".join(parts) == text and len(parts) > 2
        for encode in (byte.encode_batch, word.encode):
            assert np.concatenate(encode(parts)).tolist() == encode([text])[0].tolist()
    assert list(pool.sections("x" * 500 + "  " + "y" * 10, 40)) == ["x" * 500 + "  " + "y" * 10]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    """With all hashes equal every word is known by its bytes."""
    from mosaica.llm import pool

    texts = ["one two three two one", "three four", "éa é a", ""]
    want = library(texts)
    monkeypatch.setattr(pool, "mix", lambda x: x * np.uint64(0))
    own = token_records.WordEncoder(vocabulary(WORD_BPE))
    for _ in range(2):
        assert [g.tolist() for g in own.encode(texts)] == want
    assert len(own.words.hash) == 1
