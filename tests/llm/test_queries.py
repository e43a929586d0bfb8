"""Registered queries against their SQL or brute force, and the pipeline stage by stage."""

import hashlib
import html
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaica.llm import queries


def documents(tables):
    return tables.execute("select doc_id, text from documents order by doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, tables, data, name):
    df = queries.queries()[name](spark, data)
    cols = sorted(df.columns)
    r = tables.execute(queries.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(tuple(x[names.index(c)] for c in cols) for x in r.fetchall())


def test_op1_matches_all_pairs(spark, tables, data):
    e = tables.execute("select vec_id, embedding from embeddings order by vec_id").fetchall()
    x = np.array([v for _, v in e], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.95
    comp = np.arange(len(x))
    for _ in range(len(x)):
        new = np.where(hit, comp, len(x)).min(1)
        if (new == comp).all():
            break
        comp = new
    want = {e[i][0]: (int(hit[i].sum()) - 1, e[comp[i]][0]) for i in range(len(x))}
    assert {r.vec_id: (r.n_links, r.component_id) for r in queries.op1_embedding_dedup(spark, data).collect()} == want


def test_op5_matches_the_library(spark, tables, data):
    from tokenizers import Tokenizer

    lib, at, want = Tokenizer.from_file(queries.vocabulary(queries.WORD_BPE)), 0, []
    for doc, text in documents(tables):
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op5_token_records(spark, data).collect())) == want


def test_op7_matches_the_library(spark, tables, data):
    from tokenizers import Tokenizer

    lib, want = Tokenizer.from_file(queries.vocabulary(queries.BYTE_BPE)), {}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for doc, text in documents(tables):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        want[doc] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode(ids, skip_special_tokens=False).encode()))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op7_byte_bpe(spark, data).collect()} == want


def test_op9_matches_the_articles(spark, tables, data):
    want = {}
    for page, source in tables.execute("select page_id, html from pages").fetchall():
        a = source.find("<article>") + 9
        b = source.find("</article>")
        want[page] = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", source[a : b if b > 0 else None])).split())
    assert {r.page_id: r.text for r in queries.op9_html_extraction(spark, data).collect()} == want


def unigram_library():
    """The tokenizers library's unigram model over the same pieces; control pieces, which never stand for text, under names that no text has."""
    from tokenizers import Tokenizer, models, normalizers

    from mosaica.llm.token_counts import read_pieces

    path = queries.vocabulary(queries.PIECES)
    free = {p for p, _ in read_pieces(path, (1, 6))}
    pieces = [(p if p in free else f"\ue000{k}\ue001", s) for k, (p, s) in enumerate(read_pieces(path, (1, 2, 3, 6)))]
    lib = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    lib.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return lib


def test_op10_matches_the_library(spark, tables, data):
    lib = unigram_library()
    want = {d: len(lib.encode(t or "", add_special_tokens=False).ids) for d, t in documents(tables)}
    assert {r.doc_id: r.n_tokens for r in queries.op10_token_counts(spark, data).collect()} == want


def test_op10_never_matches_control_pieces():
    from mosaica.llm.token_counts import UnigramCounter, read_pieces

    lib, own = unigram_library(), UnigramCounter(read_pieces(queries.vocabulary(queries.PIECES)))
    texts = ["<s> </s>", "a</s>b", "<unk>", "x <s><s>", "日本語 \U0001f600 é"]
    assert own.counts(texts) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    assert own.counts(["<s>"])[0] > 1


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def plain_lines(rows):
    """Texts without recurring lines, by a dictionary of lines."""
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    gone = lambda i, line: len(h := holders.get(key(line), ())) >= 5 and max(h) != i
    return {i: None if t is None else "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in rows.items()}


def plain_windows(text, size=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return [tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []


def test_pipeline_stages(spark, tables, data, tmp_path):
    import corpus_pipeline

    docs = first = spark.read.parquet(f"{data}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{name}")
        out[name] = docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "encoding":
            assert docs.columns == first.columns
    labels = spark.read.parquet(f"{data}/labels.parquet")
    good = first.join(labels.where("quality = 1"), "doc_id", "left_semi")
    assert good.join(out["quality"], "doc_id", "left_anti").count() <= 0.02 * good.count()
    bad = out["quality"].join(labels.where("quality = 0"), "doc_id", "left_semi").count()
    assert bad <= 0.1 * labels.where("quality = 0").count()
    rows = {name: {r.doc_id: r.text for r in out[name].collect()} for name in ("quality", "lines", "near_duplicates", "decontamination")}
    assert rows["lines"] == plain_lines(rows["quality"])
    assert out["lines"].where("n_chars <> length(text)").count() == 0
    from tests.llm.test_operators import brute_near

    near = brute_near(sorted(rows["lines"].items()), 5, 80)
    assert rows["near_duplicates"] == {i: t for i, t in rows["lines"].items() if near[i][1] == i}
    windows = {w for (item,) in tables.execute("select text from benchmark").fetchall() for w in plain_windows(item)}
    clean = {i for i, t in rows["near_duplicates"].items() if windows.isdisjoint(w for n in {len(w) for w in windows} for w in plain_windows(t, n))}
    assert rows["decontamination"] == {i: t for i, t in rows["near_duplicates"].items() if i in clean}
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.vocabulary(queries.BYTE_BPE))
    want = {i: np.array(lib.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for i, t in rows["decontamination"].items()}
    assert {r.doc_id: bytes(r.ids) for r in out["encoding"].collect()} == want
    back = out["encoding"].join(out["decontamination"], "doc_id").where(F.col("decoded_sha256") != F.sha2(F.col("text").cast("binary"), 256))
    assert back.count() == 0


def test_pipeline_on_awkward_rows(spark, data):
    import corpus_pipeline
    from tests.llm.test_operators import AWKWARD, docs

    for rows in (AWKWARD, []):
        d = docs(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, d, data).count()
    kept = corpus_pipeline.unlike_documents(spark, docs(spark, AWKWARD), data)
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in kept.collect() if r.text and r.text.startswith("This")) == [(0, 56), (5, 56), (6, 113)]
