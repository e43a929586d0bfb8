"""Operators on small and awkward tables, against plain computations."""

import hashlib
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaica.llm import bpe, common, decontaminate, embed_dedup, html_extract, langid, line_dedup, minhash, quality, token_counts, token_records
from mosaica.llm.queries import BYTE_BPE, PIECES, WORD_BPE, vocabulary

LONG = "This line is longer than forty characters, that is sure."
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score double, component string, a int, __id string, pos int, h1 int, kept int"


def docs(spark, rows):
    """Documents with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", None, None, None, 0.5, "x", 1, "y", 2, 3, 4) for i, t in rows], SCHEMA)


AWKWARD = [(1, None), (2, ""), (3, " \n\t"), (4, "x"), (None, LONG), (5, LONG), (5, LONG), (6, LONG + "\n" + LONG), (7, "é" * 30_000 + " " + "word " * 20_000), (8, "\x00\x1c\x85\xa0 \U0001f600​")]


@pytest.fixture(scope="module", params=["awkward", "empty"])
def table(request, spark):
    return docs(spark, AWKWARD if request.param == "awkward" else [])


def test_line_dedup_drops_all_but_the_last(spark):
    rows = [(i, f"own line number {i}\n  {LONG.upper() if i % 2 else LONG}\t\nshort") for i in range(6)] + [(9, "short\nshort")]
    out = {r.doc_id: r for r in line_dedup.drop_lines(docs(spark, rows)).collect()}
    assert [out[i].n_dropped for i in range(6)] == [1] * 5 + [0]
    assert out[0].text == "own line number 0\nshort" and out[5].text == rows[5][1] and out[9].n_lines == 2


def test_line_dedup_counts_documents_not_rows(spark):
    rows = [(1, LONG)] * 7 + [(2, LONG), (3, LONG), (4, LONG)]
    assert line_dedup.drop_lines(docs(spark, rows)).agg(F.sum("n_dropped")).first()[0] == 0
    out = line_dedup.drop_lines(docs(spark, [*rows, (5, LONG + "\n" + LONG)]))
    assert {(r.doc_id, r.text) for r in out.collect()} == {(1, ""), (2, ""), (3, ""), (4, ""), (5, LONG + "\n" + LONG)}


def test_line_dedup_runs_are_compressed(spark):
    text = "\n".join([LONG, LONG, "keep", LONG, "keep", "keep", LONG, LONG])
    maps = line_dedup.line_bitmaps(docs(spark, [(i, text) for i in range(5)]))
    assert {tuple(r.keep_runs) for r in maps.collect()} == {(0, 2, 1, 1, 2, 2)}


def test_line_dedup_on_awkward_rows(table):
    out = line_dedup.drop_lines(table)
    assert out.columns == [*table.columns, "n_lines", "n_dropped"] and out.count() == table.count()
    got = {(r.doc_id, r.text): r.n_lines for r in out.collect()}
    assert not got or (got[1, None] == 1 and got[2, ""] == 1 and got[3, " \n\t"] == 2)


def test_components_of_random_graphs(spark):
    r = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 120, (90, 2))] + [(None, 1), (200, 200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.component for r in common.components(chain).collect()} == {0}


def brute_near(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")
        w = [x for x in w if x]
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    pairs = []
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j]) if i < j else 0
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                pairs.append((i, j))
    comp = least_reachable(sets, pairs)
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def least_reachable(nodes, pairs):
    comp = {i: i for i in nodes}
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            if comp[i] != comp[j]:
                comp[i] = comp[j] = min(comp[i], comp[j])
                changed = True
    return comp


def near_copies(seed=0, base=3, copies=12, words=90):
    r = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(base):
        b = r.choice(vocab, words).tolist()
        for _ in range(copies):
            c = list(b)
            for _ in range(int(r.integers(0, 6))):
                c[int(r.integers(0, words))] = r.choice(vocab)
            out.append(" ".join(c))
    order = r.permutation(len(out))
    return [(int(k), out[int(o)]) for k, o in enumerate(order)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_match_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 5)
    rows = [*near_copies(), (100, "one"), (101, "ONE"), (102, None), (103, " "), (104, "one two three"), (105, "One two\tthree")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark, rows), shingle=size).collect()}
    assert got == brute_near(rows, size, 80)


def test_near_duplicates_on_awkward_rows(table):
    out = minhash.near_duplicates(table)
    got = {r.doc_id: (r.component_id, r.kept) for r in out.collect()}
    assert not got or (got[5] == (5, True) and got[1] == (1, True) and got[2] == (2, True) and None not in got)


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 2**63, 300).astype(np.uint64))
    b = np.concatenate([a[:240], np.unique(r.integers(0, 2**63, 60).astype(np.uint64))])
    s = minhash.signatures([a, np.unique(b), a[:3], a[:0]])
    assert abs((s[0] == s[1]).mean() - 240 / 360) < 0.12
    assert (s[2] != 0).all() and (s[3] == 0).all()


def test_windows_are_found_with_spans(spark):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda"
    text = "é first. " + item.upper() + "! last"
    items = spark.createDataFrame([(1, item), (2, "tiny ITEM"), (3, None), (4, "..."), (None, "first")], "item_id long, text string")
    rows = [(1, text), (2, "a tiny item here"), (3, "alpha beta gamma"), (4, None), (5, "beta gamma delta epsilon zeta eta theta iota kappa lambda")]
    out = {r.doc_id: r for r in decontaminate.find_items(docs(spark, rows), items).collect()}
    assert (out[1].n_words, out[1].n_hit, out[1].item_ids) == (14, 11, ["1"])
    assert [text[s.start : s.end] for s in out[1].hit_spans] == [item.upper()]
    assert (out[2].n_hit, out[2].item_ids) == (2, ["2"]) and out[3].n_hit == 0 and out[4].n_words == 0 and out[5].n_hit == 10


def test_items_in_several_groups_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"common words number {i}") for i in range(8)], "item_id long, text string")
    d = docs(spark, [(1, "common words number 3 and common words number 7"), (2, None)])
    one = [tuple(r) for r in decontaminate.find_items(d, items).collect()]
    monkeypatch.setattr(decontaminate, "GROUP_WORDS", 9)
    assert [tuple(r) for r in decontaminate.find_items(d, items).collect()] == one and one[0][3] == ["3", "7"]


def test_decontamination_on_awkward_rows(spark, table):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_items(table, none).where("n_hit > 0").count() == 0
    assert decontaminate.find_items(table, none).count() == table.count()


ODD = ["", " ", "a<|endoftext|>b", "\n\n  x  \t", "a" * 300, "日本語テキスト ½ Ⅷ ١٢ 😀😀 é   x", " " * 300 + "y", "\x1c\x1d a\x85b\xa0c", "don't I'LL we've 'sx", "ÿ \x85 ²³¼ ªº", "aaaa aaaaa aaaaaa"]


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(vocabulary(BYTE_BPE)), bpe.load(vocabulary(BYTE_BPE))
    r = np.random.default_rng(0)
    texts = [*ODD, *("".join(map(chr, r.integers(32, 0x250, 200))) for _ in range(40)), *(" ".join("".join(r.choice(list("abcdeth ing"), 12)) for _ in range(30)) for _ in range(40))]
    ids = own.encode_batch([*texts, None])
    want = [*(lib.encode(t, add_special_tokens=False).ids for t in texts), []]
    assert [x.tolist() for x in ids] == want
    assert list(map(own.decode, ids)) == [*texts, ""] == [lib.decode(x, skip_special_tokens=False) for x in want]


def test_bpe_on_hard_words():
    """Long runs without a blank: letters, other scripts, one or two letters over and over; against the library, with a bound on the time."""
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(vocabulary(BYTE_BPE)), bpe.load(vocabulary(BYTE_BPE))
    r = np.random.default_rng(2)
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    texts = ["".join(r.choice(letters[:k], 100_000)) for k in (2, 26, 52)] + ["".join(map(chr, r.integers(0x4E00, 0x9FFF, 30_000))), "ab" * 50_000, "=" * 100_000]
    for t in texts:
        began = time.process_time()
        (ids,) = own.encode_batch([t])
        assert time.process_time() - began < 5 and ids.tolist() == lib.encode(t, add_special_tokens=False).ids
    some = [t[:n] for t in texts for n in (100, 127, 128, 129, 300, 1_000)]
    assert [x.tolist() for x in own.encode_batch(some)] == [lib.encode(t, add_special_tokens=False).ids for t in some]
    assert all((own._merge_queue(t.encode()) == own._merge_block([t.encode()])[0]).all() for t in some[::4])


def test_bpe_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_CACHED", 5)
    m = bpe.ByteBPE(vocabulary(BYTE_BPE))
    a = m.encode_batch(["one two three four five six seven eight"])[0].tolist()
    assert len(m.words.hash) <= 5 and m.encode_batch(["one two three four five six seven eight"])[0].tolist() == a


def test_bpe_on_awkward_rows(table):
    out = bpe.encode(table, vocabulary(BYTE_BPE), decoded=True)
    want = {(r.doc_id, r.text or "") for r in table.collect()}
    assert {(r.doc_id, r.decoded) for r in out.collect()} == want and out.count() == table.count()


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(vocabulary(WORD_BPE)), token_records.load(vocabulary(WORD_BPE))
    texts = [*ODD, "a<|endoftext|>b <|startoftext|> x", "ΑΣ Σ. ΟΔΟΣ", "é ́x", "A,B.C!! don't, can't!!", "İstanbul ǅ", "word. Word, (word) word's"]
    assert [x.tolist() for x in own.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_records_round_trip_and_notice_damage():
    ids = np.arange(5, dtype="<u2")
    data = b"".join(token_records.record(d, ids[:n].tobytes(), False) + b"\n" for d, n in ((7, 5), (None, 0), (10**12, 3)))
    got = [(doc, x.tolist()) for _, _, doc, x in token_records.records(data)]
    assert got == [(7, [0, 1, 2, 3, 4]), (None, []), (10**12, [0, 1, 2])]
    at, size, doc, _ = list(token_records.records(data))[2]
    assert next(token_records.records(data[at : at + size]))[2] == doc
    for k in range(len(data)):
        if data[k] != 10:
            bad = bytearray(data)
            bad[k] ^= 4
            with pytest.raises(ValueError, match="checksum"):
                list(token_records.records(bytes(bad)))


def test_records_on_awkward_rows(spark, table):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary(WORD_BPE))
    path = common.fresh_path(spark, "records")
    token_records.write_records(table, path, vocabulary(WORD_BPE))
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_records.positions(spark, path).collect())
    rows = sorted(((r.doc_id, r.text) for r in table.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    at, want = 0, []
    for doc, text in rows:
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((at, doc, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_token_counts_equal_the_library():
    from tokenizers import Tokenizer, models, normalizers

    pieces, every = token_counts.read_pieces(vocabulary(PIECES)), token_counts.read_pieces(vocabulary(PIECES), (1, 2, 3, 6))
    lib = Tokenizer(models.Unigram(every, unk_id=0, byte_fallback=True))
    lib.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    texts = [*ODD, "  a  b   c", "x\ny", "▁▁ a▁b", "The quick brown fox jumps over the lazy dog."]
    own = token_counts.UnigramCounter(pieces)
    assert own.by_word and own.counts([*texts, None]) == [*(len(lib.encode(t, add_special_tokens=False).ids) for t in texts), 0]
    some = [(p, s / 7) for p, s in pieces]
    lib = Tokenizer(models.Unigram([(p, s / 7) for p, s in every], unk_id=0, byte_fallback=True))
    lib.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    whole = token_counts.UnigramCounter(some)
    assert not whole.by_word and whole.counts(texts) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_counts_on_awkward_rows(table):
    out = token_counts.count_tokens(table, vocabulary(PIECES))
    assert out.count() == table.count() and out.where("n_chars = 0 and n_tokens <> 0").count() == 0


def test_language_needs_letters(spark):
    rows = [("der die das und ist nicht ein schön", "de"), ("the and of to in that with for", "en"), ("le la les des et que dans pour", "fr")] * 8
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    test = docs(spark, [(1, "THAT WITH the"), (2, "nicht das und"), (3, None), (4, "12 %% ½"), (5, ""), (6, "dans la")])
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(test, model).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["en", "de", "und", "und", "und", "fr"]
    assert got[3][1] == got[4][1] == 0 and all(0 <= s <= 1 for _, s in got.values())
    nothing = langid.fit(train.where("doc_id < 0"))
    assert {r.lang_pred for r in langid.predict(test, nothing).collect()} == {"und"}


def test_language_sums_don_t_depend_on_the_batch():
    table = np.random.default_rng(0).random((langid.BUCKETS, 3)).astype(np.float32)
    texts = ["one two", "", "drei, vier! fünf", "x", "\x00a\x00", "日本"]
    alone = np.vstack([langid.text_sums([t], table) for t in texts])
    assert np.allclose(langid.text_sums(texts, table), alone)


def test_language_on_awkward_rows(table):
    out = langid.predict(table, langid.fit(table))
    assert out.count() == table.count()


def test_attention_gradient_learns_a_planted_passage():
    r = np.random.default_rng(0)
    count = r.integers(1, 6, 300)
    x = r.normal(size=(count.sum(), 5)).astype(np.float32)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    y = r.integers(0, 2, 300)
    x[first[y == 1], 0] += 6  # one passage of a positive bag stands out
    p = quality.train_bags(x, count, y)
    assert ((quality.score_bags(x, count, p) > 0.5) == y).mean() > 0.95


def test_passages_don_t_depend_on_the_batch():
    texts = ["", "a", "one two three " * 70, "UP up!! \n\n é", " lead", "日本 語"]
    x, n = quality.passages(texts)
    alone = [quality.passages([t]) for t in texts]
    assert n.tolist() == [int(a[1][0]) for a in alone] == [1, 1, 4, 1, 1, 1]
    assert np.allclose(x, np.vstack([a[0] for a in alone]))


def test_quality_with_few_labels(spark, table):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(table, labels) == 1.0
    assert quality.score(table, 1.0).where("score <> 1").count() == 0
    odd = spark.createDataFrame([(1, 1, None), (2, None, 0), (None, 0, 0), (3, 7, 0), (4, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(table, odd) == 1.0
    both = spark.createDataFrame([(3, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(table, both)
    assert quality.score(table, model).where("score between 0 and 1").count() == table.count()


def test_quality_and_language_on_held_out_rows(spark, data):
    from mosaica.llm import queries

    labels = spark.read.parquet(f"{data}/labels.parquet")
    q = queries.op4_quality_classifier(spark, data).join(labels, "doc_id").where("held_out")
    assert q.where("predicted = quality").count() >= 0.9 * q.count() > 0
    lang = queries.op3_language_id(spark, data).join(spark.read.parquet(f"{data}/documents.parquet"), "doc_id").where("held_out")
    assert lang.where("lang = lang_pred").count() >= 0.9 * lang.count() > 0


def brute_vectors(rows, cosine):
    good = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    n, pairs = dict.fromkeys([i for i, _ in rows], 0), []
    for i, a in good.items():
        for j, b in good.items():
            if i != j and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= cosine:
                n[i] += 1
                pairs.append((i, j))
    comp = least_reachable(n, pairs)
    return {i: (n[i], comp[i]) for i in n}


@pytest.mark.parametrize("block", [4096, 12])
def test_range_join_matches_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK_BYTES", block * 64)
    monkeypatch.setattr(embed_dedup, "CELL", block)
    r = np.random.default_rng(4)
    base = r.normal(size=(12, 8))
    rows = [(i, (base[i % 12] * (1 + i) + r.normal(0, 0.12 * (i % 5), 8) * (1 + i)).tolist()) for i in range(80)]
    rows += [(100, None), (101, []), (102, [0.0] * 8), (103, [1.0, None] + [0.0] * 6), (104, [float("nan")] * 8), (105, [float("inf")] * 8), (106, [1.0, 0.0]), (107, [2.0, 0.0]), (108, rows[0][1])]
    d = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cell int, v int")
    got = {x.vec_id: (x.n_links, x.component_id) for x in embed_dedup.near_vectors(d).collect()}
    assert got == brute_vectors(rows, 0.95)
    assert embed_dedup.near_vectors(d.where("vec_id < 0")).count() == 0


def test_range_join_keeps_links_across_pivots_of_one_direction(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK_BYTES", 12 * 512)
    monkeypatch.setattr(embed_dedup, "CELL", 12)
    r = np.random.default_rng(7)
    base = r.normal(size=(6, 64))
    # rescaled copies of six vectors: equal up to rounding, and so are about eight pivots of each
    rows = [(i, (base[i % 6] * r.uniform(0.1, 10)).tolist()) for i in range(600)]
    got = embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {x.vec_id: (x.n_links, x.component_id) for x in got} == {i: (99, i % 6) for i in range(600)}


PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><!-- <p>gone</p> --><div class="cookie-notice"><p>We use cookies, as everyone does, to be sure.</p></div>
<article><h1>A  Title &eacute;</h1><p>First <b>bold</b>er text, with &lt;signs&gt;.<p>Second<br>line of it, here.</article>
<section id="comments"><p>Great piece, thank you so much for writing it!</p></section><form><p>Search the site</p><input></form><footer>&copy; Some One</footer>"""


def test_article_text_of_a_page(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 7, "x"), (2, None, None, 7, "x"), (3, "w", "", 7, "x"), (4, "w", "<<<p", 7, "x"), (5, "w", "<p>" * 3000 + "deep text, really.", 7, "x")], "page_id long, url string, html string, n_chars int, __html string")
    out = {r.page_id: r for r in html_extract.extract(pages.withColumnRenamed("__html", "source_html")).collect()}
    assert out[1].text == "A Title é First bolder text, with <signs>. Second line of it, here."
    assert out[1].n_chars == len(out[1].text) and out[2].text == "" and out[3].text == ""
    assert html_extract.extract(pages.where("page_id < 0")).count() == 0


def test_messages_match_enumeration():
    import itertools
    import math

    parent, u, pair = [-1, 0, 0, 1, 1, 4], [0.3, -1, 2, 0.5, -0.7, 40.0], (0.4, -0.3, -0.9, 0.6)
    p, logz, _ = html_extract.marginals(parent, u, pair)
    z, q = 0.0, np.zeros(6)
    for y in itertools.product((0, 1), repeat=6):
        v = math.exp(sum(u[i] * y[i] for i in range(6)) + sum(pair[2 * y[parent[i]] + y[i]] for i in range(1, 6)))
        z += v
        q += v * np.array(y)
    assert np.allclose(p, q / z) and abs(logz - math.log(z)) < 1e-9
    p, logz, _ = html_extract.marginals([-1] + [0] * 5000, [30.0] * 5001, pair)
    assert all(0 <= x <= 1 for x in p) and math.isfinite(logz)


def test_model_tells_blocks_of_new_pages():
    model, right, n = html_extract.train(), 0, 0
    for source, labels in html_extract.labelled_pages(80, seed=99):
        page = html_extract.Page(source)
        p = page.content(model)
        for node in {k for k, _ in page.runs}:
            right += (p[node] >= 0.5) == labels[node]
            n += 1
    assert right / n > 0.97


def test_fresh_paths_are_shared(spark):
    assert common.fresh_path(spark, "x") != common.fresh_path(spark, "x")
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit("").cast("binary"), 256)).first()[0]


BIG = 2**60 + 1


def test_ids_beside_nulls_stay_whole(spark):
    """Ids of 61 bits in a batch with a null: no operator takes them through floating point."""
    d = spark.createDataFrame([(BIG, "some words here", "en"), (None, "more words there", "en"), (-BIG, None, None)], "doc_id long, text string, lang string")
    ids = {BIG, None, -BIG}
    assert {r.doc_id for r in langid.predict(d, langid.fit(d)).collect()} == ids
    assert {r.doc_id for r in bpe.encode(d, vocabulary(BYTE_BPE), decoded=True).collect()} == ids
    assert {r.doc_id for r in token_counts.count_tokens(d, vocabulary(PIECES)).collect()} == ids
    path = common.fresh_path(spark, "big")
    token_records.write_records(d, path, vocabulary(WORD_BPE))
    assert {r.doc_id for r in token_records.positions(spark, path).collect()} == ids
    pages = d.select("doc_id", F.col("text").alias("html"), F.col("doc_id").alias("other"))
    assert {(r.doc_id, r.other) for r in html_extract.extract(pages).collect()} == {(i, i) for i in ids}
    assert {r.doc_id for r in quality.score(d, 1.0).collect()} == ids
    assert {r.doc_id for r in decontaminate.find_items(d, d.select(F.col("doc_id").alias("item_id"), "text")).collect()} == ids
    assert {r.doc_id for r in minhash.near_duplicates(d).collect()} == ids - {None}
    assert {r.doc_id for r in line_dedup.drop_lines(d).collect()} == ids


def test_language_counts_and_scores_by_dictionary(spark):
    """The model and its scores against counts of n-grams in dictionaries, bucket by bucket."""
    import math
    import zlib as z

    texts = [("The cat, the hat", "en"), ("der Hut 12 der", "de"), ("Ça va? là", "fr"), ("hat the cat", "en")]
    model = langid.fit(spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string"))

    def grams(text):
        t = "".join(c if ord(c) > 127 or "a" <= c <= "z" else " " for c in text.lower())
        t = " " + " ".join(t.split(" ")) + " "
        while "  " in t:
            t = t.replace("  ", " ")
        out = {}
        for n in langid.GRAMS:
            for k in range(len(t) - n + 1):
                c = np.array([ord(x) for x in t[k : k + n]], np.uint32)
                b = int(langid.buckets(c, n)[0])
                out[b] = out.get(b, 0) + 1
        return out

    langs = sorted({lang for _, lang in texts})
    assert model[0] == langs and z.crc32(b"") == 0
    total = {lang: {} for lang in langs}
    for text, lang in texts:
        for b, n in grams(text).items():
            total[lang][b] = total[lang].get(b, 0) + n
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs(spark, [(1, "the hut"), (2, "là chat"), (3, "Der, der!")]), model).collect()}
    for doc, text in ((1, "the hut"), (2, "là chat"), (3, "Der, der!")):
        logs = []
        for lang in langs:
            size = sum(total[lang].values()) + langid.SMOOTHING * langid.BUCKETS
            logs.append(math.log(sum(x == lang for _, x in texts) / len(texts)) + sum(n * math.log((total[lang].get(b, 0) + langid.SMOOTHING) / size) for b, n in grams(text).items()))
        best = max(range(len(langs)), key=lambda k: logs[k])
        assert got[doc][0] == langs[best]
        assert got[doc][1] == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs), abs=1e-4)


def test_quality_forward_pass_and_gradient_by_plain_loops():
    r = np.random.default_rng(5)
    count, y, weight = np.array([1, 3, 2]), np.array([1, 0, 1]), np.array([0.5, 1.0, 0.25])
    x = r.normal(size=(6, 4))
    p = {"W": r.normal(size=(4, 3)), "b": r.normal(size=3), "V": r.normal(size=(3, 2)), "U": r.normal(size=(3, 2)), "w": r.normal(size=2), "c": r.normal(size=3), "d": np.array(0.3), "mean": r.normal(size=4), "scale": np.array([1.0, 2.0, 0.5, 1.5])}

    def loss(p):
        total, at = 0.0, 0
        for n, label, w in zip(count, y, weight, strict=True):
            hs, es = [], []
            for row in x[at : at + n]:
                h = np.tanh((row - p["mean"]) / p["scale"] @ p["W"] + p["b"])
                hs.append(h)
                es.append(float((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]))
            a = np.exp(es) / np.exp(es).sum()
            s = 1 / (1 + np.exp(-(sum(ai * h for ai, h in zip(a, hs, strict=True)) @ p["c"] + p["d"])))
            total -= w * np.log(s if label else 1 - s)
            at += n
        return total

    bags = quality.score_bags(x, count, p)
    assert -(weight * np.log(np.where(y == 1, bags, 1 - bags))).sum() == pytest.approx(loss(p))
    for name, grad in quality.gradient(x, count, y, weight, p).items():
        for at in np.ndindex(p[name].shape):
            up, down = (p | {name: p[name].copy()} for _ in range(2))
            up[name][at] += 1e-6
            down[name][at] -= 1e-6
            assert np.asarray(grad)[at] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-6)


def test_fit_takes_few_passages_of_long_texts(spark):
    rows = [(k, ("good words again " if k % 2 else "BAD!! ") * (40_000 if k < 2 else 30)) for k in range(8)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality.fit(d, labels, most=4)
    assert {r.doc_id: r.score > 0.5 for r in quality.score(d, model).collect()} == {k: bool(k % 2) for k in range(8)}


def test_range_join_in_parted_cells_with_copies(spark, monkeypatch):
    """Cells that are parted twice, copies that stand in for each other, and visitors that stream in chunks: as brute force has it."""
    monkeypatch.setattr(embed_dedup, "BLOCK_BYTES", 12 * 48)
    monkeypatch.setattr(embed_dedup, "CHUNK", 5)
    monkeypatch.setattr(embed_dedup, "CELL", 8)
    monkeypatch.setattr(embed_dedup, "MAX_PIVOTS", 4)
    monkeypatch.setattr(embed_dedup, "CHILDREN", 64)
    r = np.random.default_rng(8)
    base = r.normal(size=(40, 6))
    rows = [(i, (base[i % 40] + r.normal(0, 0.03 * (i % 4), 6)).tolist()) for i in range(240)]
    rows += [(300 + i, rows[7][1]) for i in range(30)] + [(400 + i, rows[8 * i][1]) for i in range(6)]
    got = {x.vec_id: (x.n_links, x.component_id) for x in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == brute_vectors(rows, 0.95)


def test_rows_dealt_grow_in_proportion_on_clustered_vectors(spark, monkeypatch):
    """At three sizes of tightly clustered vectors: rows dealt for each vector do not grow."""
    monkeypatch.setattr(embed_dedup, "BLOCK_BYTES", 64 * 24 * 8)
    monkeypatch.setattr(embed_dedup, "CELL", 16)
    seen = []
    plain = embed_dedup.deal
    monkeypatch.setattr(embed_dedup, "deal", lambda *a: (lambda d: (seen.append(d.count()), d)[1])(plain(*a)))
    r = np.random.default_rng(1)
    for n in (500, 2_000, 8_000):
        centres = r.normal(size=(n // 64, 24))
        rows = [(i, (centres[i % len(centres)] + r.normal(0, 0.01, 24)).tolist()) for i in range(n)]
        out = embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        assert out.where("n_links < 63").count() == 0
    assert seen[2] / 8_000 <= 1.6 * seen[0] / 500


def test_candidates_recall_pairs_near_the_threshold(spark):
    """Pairs just above a similarity of 0.8, by set size, each within a cloud of half-similar documents: all are found."""
    r = np.random.default_rng(6)
    rows, want = [], {}
    for k in range(150):
        n = int(r.choice([6, 10, 20, 60, 200]))
        words = [f"w{k}x{i}" for i in range(n + 1)]
        other = list(words)
        for _ in range(max(1, round(n * 0.2 / 1.8 / 2))):
            other[int(r.integers(1, n))] = f"v{k}"
        half = words[: n // 2] + [f"u{k}x{i}" for i in range(n // 2)]
        for text in (words, other, half):
            rows.append((len(rows), " ".join(text)))
    want = brute_near(rows, 2, 80)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(docs(spark, rows), shingle=2).collect()}
    linked = {i for i, (_, c) in want.items() if c != i}
    assert len(linked) > 30 and {i for i in linked if got[i] != want[i]} == set() and got == want


def test_pairs_are_found_among_many_half_alike_documents(spark):
    """A cloud of documents that share their greater part, below half by shingles, with lower ids than the pairs: hubs of all buckets are of the cloud."""
    r = np.random.default_rng(2)
    common = [f"c{i}" for i in range(110)]
    own = lambda k, n: [f"o{k}x{i}" for i in range(n)]
    rows = [(k, " ".join(common + own(k, 80))) for k in range(700)]
    for k in range(30):
        words = common + own(10_000 + k, 80)
        other = list(words)
        for at in r.choice(len(words), 9, replace=False):
            other[at] = f"z{k}"
        rows += [(1_000 + 2 * k, " ".join(words)), (1_001 + 2 * k, " ".join(other))]
    sets = {i: {tuple(t.split()[k : k + 2]) for k in range(len(t.split()) - 1)} for i, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.3 < alike(0, 1) < 0.5 and alike(3, 1_000) < 0.5
    want = {1_001 + 2 * k for k in range(30) if alike(1_000 + 2 * k, 1_001 + 2 * k) >= 0.8}
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(docs(spark, rows), shingle=2).collect()}
    assert len(want) > 20 and {i for i, c in got.items() if c != i} == want


def test_batches_of_dealt_vectors_are_bounded(spark):
    import numpy as np

    from mosaica.llm import embed_dedup

    n, width = 3000, 512
    v = spark.createDataFrame([(i, 1, bytes(width), 0) for i in range(n)], "id long, m long, v binary, cell long").coalesce(1)
    assert sum(s.stop - s.start for s in embed_dedup._slices(10 * 8192, width)) == 10 * 8192
    assert all(s.stop - s.start <= embed_dedup.BATCH_BYTES // width for s in embed_dedup._slices(100_000, width))
    dealt = embed_dedup.deal(v, v, {0: (n, n)}, 10, width).select("side", "id", "i", "j").toPandas()
    parts = -(-n // embed_dedup._block(n, 10))
    assert parts == -(-n // 40) and len(dealt) == 2 * n * parts  # a large cell has blocks four times as large
    homes, visits = dealt[dealt["side"] == 0], dealt[dealt["side"] == 1]
    assert (np.bincount(homes["id"]) == parts).all() and (np.bincount(visits["id"]) == parts).all()
    assert homes.groupby("id")["i"].nunique().max() == 1 and visits.groupby("id")["j"].nunique().max() == 1
