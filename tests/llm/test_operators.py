from __future__ import annotations

import hashlib
import html as html_lib
import json
import math
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from chatlake.llm import bpe, common, embedding_dedup, html_extraction, jaccard_join, language_id, packing, quality_rules, queries, token_counts, url_filters, warc
from chatlake.llm.components import connected_components
from conftest import SF
from oracle import same

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Nulls, empty and odd texts, repeats, very long words, and columns whose names clash with the operators' own.
TEXTS = [None, "", " ", "a", "a  b\n\n c \t d ", "don't <|endoftext|> x", "▁x ▁▁", "x" * 3000, "日本語 한국어 é\x00\x1c", "same text " * 12, "same text " * 12, "12 34 %% !!", "ab " * 40_000]


@pytest.fixture
def hot(monkeypatch):
    """Take keys of few rows for hot ones; the SQL tests take the other way."""
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_KEYS", 10**9)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k if k != 4 else None, t, "en", "s", 1, "k", "n", "q") for k, t in enumerate(TEXTS)] + [(1, "", "en", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, _n string, id string").repartition(3)


def _texts(spark, name="documents", column="text", key="doc_id"):
    return {r[0]: r[1] for r in spark.read.parquet(f"{SF}/{name}.parquet").select(key, column).collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, SF, queries.queries()[name], queries.oracle_sql()[name])


def _article(page):
    body = re.sub(r"<[a-z/][^>]*$", "", re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1])
    blocks = (" ".join(html_lib.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:h1|p)>", body))
    return "\n\n".join(x for x in blocks if x)


def _blocks(pages, **options):
    return [x for x, _, _ in html_extraction.extract(pages, **options)]


def test_html(spark):
    pages = _texts(spark, "pages", "html", "page_id")
    for r in queries.op1_html_extraction(spark, SF).collect():
        assert r["text"] == _article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])
    shell = "<body><div>Site name</div><div class=x><p>{}</p><p>Follow our letters every week</p><ul><li>one &lt; two</ul></div><div class='cookie-notice'>ok</div><div id=comments>me</div><form>f</form></body>"
    found = _blocks([shell.format(f"Body number {k} " + f"w{k}" * 40) for k in range(9)])
    assert found[3] == ["Body number 3 " + "w3" * 40]  # what all pages have is template
    copies = _blocks([shell.format("The same body of a copied page, long enough to be most of the page's own text, and longer still")] * 9)
    assert "The same body" in " ".join(copies[0])
    rows = [(1, None, None, "x"), (None, "http://a/b", "", "x"), (1, None, "<p>a<p>b", "x"), (2, "q", "<" * 50, "x"), (2, "q", "<" * 50, "x")]
    empty = spark.createDataFrame(rows, "page_id long, url string, html string, _host string").withColumn("text", F.lit("z"))
    assert sorted(r["text"] for r in html_extraction.extract_main_text(empty).collect()) == ["", "", "<" * 50, "<" * 50, "a\n\nb"]
    assert html_extraction.extract_main_text(empty.limit(0)).count() == 0
    deep = "<div>" * 5000 + "deep<nav>menu</nav>" + "</div>" * 5000 + "</p></li>" * 5000
    assert _blocks([deep]) == [["deep"]]


def test_html_induction_decides():
    pages = pd.read_parquet("/root/testdata/sf0.1/pages.parquet")
    by_host = pages.groupby(pages["url"].str.extract(r"://([^/?#]*)")[0].str.lower())["html"]
    large = [list(x)[: html_extraction.BLOCK] for _, x in by_host if len(x) >= 90]
    assert sum(map(len, large)) > 400
    for block in large:
        # The pages' own menus, adverts and footers go by alignment alone, without tags, classes and marked regions, and all of the article stays.
        assert ["\n\n".join(x) for x in _blocks(block)] == list(map(_article, block)) and all(d for _, _, d in html_extraction.extract(block))
        assert _blocks(block, lists=False, strict=False) == _blocks(block)
        assert all(len(x) > len(y) for x, y in zip(_blocks(block, induction=False), _blocks(block), strict=True))
    menus, notes = [f"Menu of kind {k}" for k in range(5)], [f"Please note number {k} of our house rules" for k in range(3)]
    made = [f"<div><div>{menus[k % 5]}</div><div><p>{'own ' * 5}{k} {f'word{k} ' * 9}</p>{'<p>A passage that a third of the pages quote</p>' * (k % 3 == 0)}<p>{f'more{k} ' * 9}</p></div><div>{notes[k % 3]}</div></div>" for k in range(60)]
    assert [len(x) for x in _blocks(made)] == [2 + (k % 3 == 0) for k in range(60)]  # the quoted passage is no template
    assert [len(x) for x in _blocks(made, induction=False)] == [4 + (k % 3 == 0) for k in range(60)]
    copied = [x.replace("word1 ", "other ") if k % 2 else x for k, x in enumerate([*made[:20], *([made[1]] * 40)])]
    assert len(_blocks(copied)[30]) == 2  # copies, more than half of the block, are no template either


def test_html_loses_and_adds_nothing():
    def text(page, **options):
        return _blocks([page], **options)[0]

    assert text('<article><p>one</p><svg width="1"/><p>two</p></article>') == ["one", "two"]
    assert text("<p>one</p><svg width=1><p>two</p>") == ["one", "two"]  # never closed
    assert text('<p>one</p><svg><text>in</text></svg><p>two</p><math/><p>three') == ["one", "two", "three"]
    assert text('<div class="layout has-sidebar"><p>The whole article.</p></div>') == ["The whole article."]
    assert text('<div class="sidebar-layout"><p>The whole article.</p></div>') == ["The whole article."]
    assert text('<div class="main-sidebar"><p>links</p></div><div class="x"><p>The whole article.</p></div>') == ["The whole article."]
    page = '<main><p>{}</p><section id="comments"><article>reader says a lot more than the page itself does</article></section></main>'
    assert text(page.format("x")) == ["x"] and text(page.format("a long text " * 9)) == [("a long text " * 9).strip()]
    assert text('<article><p>x</p><article class="comment">reader</article></article>') == ["x"]
    assert text("<head><title>t</title><body><p>all</p>") == ["all"] and text("<head><meta a=b><p>all</p>") == ["all"]
    assert text('<article><p>one</p><div class="related-work"><p>two</p></div><div class="related-posts">no</div></article>') == ["one", "two"]
    assert text('<ul class="menu"><li><a>a menu of many words</a><li><a>and more of them</a></ul><p>short</p>') == ["short"]


def test_html_comments_go_where_induction_decides():
    made = [f"<body><div>Our site</div><div><p>Body {k} {f'w{k} ' * 30}</p></div><div class=comments><p>reader {k} says {f'c{k} ' * 50}</p></div></body>" for k in range(100)]
    found = html_extraction.extract(made)
    assert all(d and len(b) == 1 and b[0].startswith(f"Body {k} ") for k, (b, _, d) in enumerate(found))
    assert all(not d for _, _, d in html_extraction.extract(made[:50]))


def test_html_long_pages():
    pages = ["<body><nav>Menu</nav>" + "".join(f"<p>text {k if i % 3 else ''} {i}</p>" for i in range(20_000)) + "<p>Same end</p></body>" for k in range(8)]
    start = time.time()
    found = _blocks(pages)
    assert time.time() - start < 60 and all(len(x) >= 13_333 and "Same end" not in x for x in found)
    bodies = _blocks(["<body>" + "".join(f"<p>{i} of {k}</p><h2>{k}-{i}</h2>" for i in range(10_000)) + "</body>" for k in range(5)])
    assert all(len(x) == 20_000 for x in bodies)


def test_token_counts(spark, odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in queries.op2_token_counts(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect():
        assert r["n_tokens"] == len(sp.encode(r["text"])) and r["over_limit"] == (r["n_tokens"] > 4096) and r["n_bytes"] == len(r["text"].encode())
    got = sorted(map(tuple, token_counts.count_tokens(odd, PIECES).select("n_bytes", "n_tokens").collect()))
    assert got == sorted((len((t or "").encode()), len(sp.encode(t or ""))) for t in [*TEXTS, ""])


def test_bpe(spark, odd):
    tok = Tokenizer.from_file(BPE)

    def want(t):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    docs = _texts(spark)
    for r in queries.op8_bpe(spark, SF).collect():
        assert tuple(r)[1:] == want(docs[r["doc_id"]])
    assert sorted(tuple(r)[1:] for r in bpe.bpe_round_trip(odd, BPE).collect()) == sorted(map(want, [*TEXTS, ""]))
    ids = odd.select("text", bpe.bpe_encode(F.col("text"), BPE).alias("ids")).withColumn("back", bpe.bpe_decode(F.col("ids"), BPE))
    assert all(r["back"] == (r["text"] or "") and r["ids"] == tok.encode(r["text"] or "", add_special_tokens=False).ids for r in ids.collect())
    b = bpe.load(BPE)
    assert b._long([b.first[x] for x in b"abababthethe" * 9]) == b.word(b"abababthethe" * 9)


def _check_packing(pieces, ids_of, size=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids_of)
    for i, parts in by_doc.items():
        ids, at = np.array(ids_of[i], "<u4"), 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    total = padding = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= size
        total, padding = total + at, padding + (0 if at & (at - 1) == 0 else size - at)
    assert padding <= 0.01 * total


def test_packing(spark, odd):
    tok = Tokenizer.from_file(BPE)
    docs = _texts(spark)
    _check_packing(queries.op3_packing(spark, SF).collect(), {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in docs.items()})
    some = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = packing.pack(some, BPE, with_ids=True).collect()
    _check_packing(got, {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(TEXTS) if i != 4})
    assert all(len(r["ids"]) == r["length"] for r in got) and packing.pack(odd, BPE).where("start = 0").count() == 14
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 2, indexing="ij"), -1).reshape(-1, 2)
    walk = grid[np.argsort(packing.hilbert_keys(grid, 3))]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()  # the curve goes from cell to neighbouring cell


def test_url_filters(spark, hot):
    link, jump = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    rows = [
        (1, "http://a.example.net/x", jump.format("https://b.org/y")), (2, "https://b.org/y#z", link.format("http://example.com/en/1")), (3, "http://www.example.com/en/q", ""), (None, None, None), (5, "none", "x"),
        (6, "http://c.org/a/b", link.format("d")), (7, "http://c.org/a/d", link.format("//www.example.com/en/k")), (8, "http://z.org/", link.format("http://x.net/es/")), (8, "http://z.org/", link.format("http://www.example.com/en/")),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, rule string")
    got = sorted((r["page_id"] or 0, r["host"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(pages, queries.URL_RULES).collect())
    assert [(x[0], x[3]) for x in got] == [(0, "allow"), (1, "block"), (2, "block"), (3, "allow"), (5, "allow"), (6, "allow"), (7, "allow"), (8, "allow"), (8, "allow")]
    given = spark.createDataFrame([("http://c.org/a/b", "http://x.net/fr/"), (None, "x")], "from_url string, to_url string")
    assert url_filters.filter_urls(pages, queries.URL_RULES, html_col=None, redirects=given).where("page_id = 6").first()["verdict"] == "block"
    assert url_filters.filter_urls(pages.limit(0), queries.URL_RULES).count() == 0


def test_alias_edges_of_odd_links(spark):
    rows = [
        ("http://k.org/a/b/p", '<link href="../../x" rel="alternate canonical">'), ("http://k.org/c", "<!-- <link rel=canonical href=/no> --><link rel=canonical href=./d/../e?q=1/../2#f>"), ("http://k.org/g", "<link rel='not-canonical' href=/no>"),
        ("http://k.org/h", '<!-- <link rel="canonical" href="/no">'), ("http://k.org/i/j", '<link rel="canonical" href="..">'), ("http://k.org/l", '<link rel=CANONICAL href="http://M.org/../../n/./">'), (None, "<link rel=canonical href=/x>"), ("http://o.org", None),
    ]
    got = {tuple(r) for r in url_filters.alias_edges(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got == {("k.org/a/b/p", "k.org/x"), ("k.org/c", "k.org/e?q=1/../2"), ("k.org/i/j", "k.org/"), ("k.org/l", "m.org/n/")}


def test_url_rules_by_join(spark, monkeypatch):
    rules = [*queries.URL_RULES, *((f"r{k}.example.com/p{k}/", "block") for k in range(200)), ("r7.example.com/p7/x/", "allow"), ("r7.example.com/", "block"), ("com/en", "block")]
    urls = [None, "q", "http://R7.example.com/p7/x/y", "http://r7.example.com/p7/", "http://a.r7.example.com/q", "http://r8.example.com/p8", "http://r8.example.com/p8/z", "http://x.net/es/", "http://x.net/es", "http://b.com/en", "http://b.com/entry", "http:///", "http://com", *[f"http://r{k}.example.com/p{k}/1?x" for k in range(60)]]
    pages = spark.createDataFrame(list(enumerate(urls + urls)), "page_id long, url string").withColumn("action", F.lit("x"))
    by_join = sorted(map(str, url_filters.filter_urls(pages, rules, html_col=None).collect()))
    table = spark.createDataFrame(rules, "rule string, action string")
    assert by_join == sorted(map(str, url_filters.filter_urls(pages, table, html_col=None).collect()))
    monkeypatch.setattr(url_filters, "MAX_RULES", 10**6)
    assert by_join == sorted(map(str, url_filters.filter_urls(pages, rules, html_col=None).collect())) and len(by_join) == 2 * len(urls)


def _slow_language(model, text):
    """The score of a text word by word, by the definition."""
    total = np.zeros(len(model.languages))
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        if w in model.words:
            total += model.word_rows[model.words[w]].astype(float)
            continue
        marked = f"^{w}$"
        for at in range(len(marked)):
            known = [marked[at : at + n] for n in (4, 3, 2, 1) if at + n <= len(marked) and marked[at : at + n] in model.grams]
            if known:
                total += model.gram_rows[model.grams[known[0]]].astype(float) / 3
    return total


def test_language_equals_brute_force(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    texts = _texts(spark)
    for r in queries.op5_language_id(spark, SF).collect():
        total = _slow_language(model, texts[r["doc_id"]])
        if r["lang_pred"] == "und":
            assert not re.search(r"[^\W\d_]", texts[r["doc_id"]] or "") and r["score"] == 0
            continue
        assert total[model.languages.index(r["lang_pred"])] >= total.max() - 1e-6 * (1 + abs(total.max()))
        assert r["score"] == pytest.approx(1 / np.exp(total - total.max()).sum(), rel=1e-3)
    tied = language_id.LanguageModel(["a", "b"], {}, np.zeros((0, 2), np.float32), {}, np.zeros((0, 2), np.float32))
    scorer = language_id.Scorer(tied)
    assert scorer.predict("word") == ("a", 0.5) and scorer.predict(None) == ("und", 0.0)
    few = spark.createDataFrame([(k, "rare words here " * 3 if k % 100 == 0 else f"common text {k}", "xx" if k % 100 == 0 else "en") for k in range(2000)], "doc_id long, text string, lang string")
    assert language_id.fit(few, max_rows=100).languages == ["en", "xx"]


def test_language(spark, odd):
    got = queries.op5_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got)
    rows = {r["doc_id"]: r for r in language_id.identify(odd).collect()}
    assert rows[0]["lang_pred"] == rows[11]["lang_pred"] == "und" and rows[0]["score"] == 0 and rows[3]["lang_pred"] == "en"
    assert language_id.identify(odd.limit(0)).count() == 0
    assert {r[0] for r in language_id.keep_identified(odd).select("doc_id").collect()} >= {3, 7}


def _slow_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    hit = {i + k for v in windows.values() if len(v) > 1 for i in v for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(hit)


def test_quality(spark, odd):
    for r in quality_rules.quality_report(odd).join(odd.select("doc_id", "text"), "doc_id").collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_repeat_words"]) == _slow_quality(r["text"])
    good = "This is a line of quite ordinary words that ends well and says something new. "
    more = " ".join(f"word{k}" for k in range(60))
    text = f"{good}\nThere is {more}.\nHome | News | About | Contact\nWE SELL CHEAP THINGS HERE!!\n{good}"
    out = quality_rules.judge(text)
    assert out[6] and out[3] == 1 and out[8] == f"{good}\nThere is {more}."
    assert not quality_rules.judge("a | b | c | " * 20)[6] and not quality_rules.judge(None)[6]
    assert quality_rules.clean_documents(odd).columns == odd.columns
    menu = "Home\nOur products\n\nLatest news\nContact\n"
    out = quality_rules.judge(menu + f"{good}\n" + "A heading\n" + f"There is {more}.\nThe end")
    assert out[6] and out[8].split("\n") == ["", good, "A heading", f"There is {more}.", "The end"]
    assert quality_rules.quality_report(odd.limit(0)).count() == 0


def _sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _classes(n, linked):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_jaccard(spark, odd, hot):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(5000, 60).astype(str)) for _ in range(6)]
    texts = [*TEXTS]
    for k in range(420):  # a large group of near copies, smaller ones, and texts of a shared passage
        w = base[0 if k < 300 else k % 6].split(" ")
        w[int(rng.integers(0, 60))] = f"new{k}"
        texts.append(" ".join(w) if k < 400 else " ".join(w[:20]) + f" tail{k} " * 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("size", F.lit(1)).withColumn("node", F.lit("x"))
    sets = [_sets(t) for t in texts]
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    degree, classes = defaultdict(int), _classes(len(sets), linked)
    for a, b in linked:
        degree[a] += 1
        degree[b] += 1
    got = {r["doc_id"]: r for r in jaccard_join.similar_documents(docs).collect()}
    assert [(got[i]["class_id"], got[i]["n_links"]) for i in range(len(texts))] == [(classes[i], degree[i]) for i in range(len(texts))]
    kept = jaccard_join.keep_one(docs)
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(set(classes)) and kept.columns == docs.columns
    assert jaccard_join.similar_documents(odd).count() == 14 and jaccard_join.similar_documents(odd.limit(0)).count() == 0


def test_jaccard_null_ids_and_ids_of_several_texts(spark):
    w = [f"w{k}" for k in range(60)]
    near = " ".join([*w[:-1], "x"])
    other = " ".join(f"v{k}" for k in range(30))
    rows = [(1, " ".join(w)), (None, near), (None, near), (None, other), (None, other + " "), (5, other + " y"), (5, "something else"), (5, "something else"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("key", F.lit("k"))
    got = sorted(((r["doc_id"] or 0), r["class_id"] or 0, r["n_links"], r["kept"]) for r in jaccard_join.similar_documents(docs).collect())
    assert got == sorted([(1, 1, 2, True), (0, 1, 2, False), (0, 1, 2, False), (0, 5, 2, False), (0, 5, 2, False), (5, 5, 2, True), (5, 5, 1, True), (5, 5, 1, True), (0, 0, 0, False), (0, 0, 0, False)])
    kept = sorted(map(str, (tuple(r)[:2] for r in jaccard_join.keep_one(docs).collect())))
    assert kept == sorted(map(str, [(1, rows[0][1]), (5, rows[5][1]), (5, "something else"), (None, None), (None, "")]))


def test_jaccard_recall_at_the_threshold_and_large_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = []
    for k in range(300):  # 92 n-grams, of which 10 change: J = 82 / 102 = 0.804
        w = [f"p{k}w{i}" for i in range(96)]
        texts += [" ".join(w), " ".join([*w[:86], *(f"q{k}w{i}" for i in range(10))])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard_join.similar_documents(docs).where("n_links = 1").count()
    print(f"recall at J = 0.804: {got / 600:.4f}")
    assert got >= 0.97 * 600
    chain = [f"c{i}" for i in range(500)]  # each is near the next few only, all in one part
    docs = spark.createDataFrame([(k, " ".join(chain[k : k + 100])) for k in range(400)], "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "WIDE", 50)
    monkeypatch.setattr(jaccard_join, "EXACT_BLOCK", 20)
    links = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in jaccard_join.similar_documents(docs).collect()}
    reach = 10  # 96 n-grams, shifted by s: (96 - s) / (96 + s) >= 0.8
    want = {k: (min(k, reach) + min(399 - k, reach), 0) for k in range(400)}
    found = sum(x[0] for x in links.values()) / sum(x[0] for x in want.values())
    print(f"links of a chain: {found:.4f}")
    assert 0.97 <= found <= 1 and {x[1] for x in links.values()} == {0} and all(links[k][0] <= want[k][0] for k in want)


def _embeddings(spark, hot=None):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(16)
    vectors = [(centre + 0.2 * rng.standard_normal(16)).tolist() for _ in range(600)] + [rng.standard_normal(16).tolist() for _ in range(200)]
    rows = [(k, v) for k, v in enumerate([*vectors, vectors[0], vectors[0], [0.0] * 16, None, [1.0, None], [float("nan")] * 16, [], [3e300] * 16, [1e-320] * 4])]
    x = np.array([v for _, v in rows[:802]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T >= 0.9
    np.fill_diagonal(s, False)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit(1)).withColumn("part", F.lit("x")), s


def _check_embeddings(got, s):
    found = sum(got[k]["n_links"] for k in range(802))
    print(f"links found: {found / s.sum():.4f}")
    assert 0.98 * s.sum() <= found <= s.sum()
    assert [got[k]["component_id"] for k in range(802)] == _classes(802, [(int(a), int(b)) for a, b in zip(*np.nonzero(s), strict=True)])
    assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k and got[k]["kept"] for k in range(802, 809))


def test_embeddings(spark, hot):
    table, s = _embeddings(spark)
    _check_embeddings({r["vec_id"]: r for r in embedding_dedup.near_duplicates(table).collect()}, s)
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [1.0, 2.001]), (None, [1.0, -1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(str, (tuple(r) for r in embedding_dedup.near_duplicates(nulls).collect()))) == ["(7, 2, 7, True)", "(8, 2, 7, False)", "(None, 0, None, False)", "(None, 2, 7, False)"]


def test_embeddings_by_blocks_and_within_buckets(spark, monkeypatch):
    table, s = _embeddings(spark)
    for name, value in (("BUCKET", 64), ("NEAR_BLOCK", 100), ("BLOCK", 50)):
        monkeypatch.setattr(embedding_dedup, name, value)
    _check_embeddings({r["vec_id"]: r for r in embedding_dedup.near_duplicates(table).collect()}, s)
    # A part of more than WIDE vectors may be compared within its buckets: a pair there counts in the least of those alone.
    chosen = spark.createDataFrame([(0, k, 9) for k in range(9)], "part int, key long, _n long")
    leaves = spark.createDataFrame([(k // 2 + 10, k) for k in range(9)] + [(7, 0), (7, 1), (8, 0), (8, 1), (8, 2)], "node long, key long")
    rows = common.pairs_to_compare(chosen, leaves, 50, 3).collect()
    assert {r["node"] for r in rows} == {7, 8, 10, 11, 12, 13} and all(r["p"] == r["q"] == 0 for r in rows)
    counted = [(x["key"], y["key"]) for node in (7, 8, 10, 11, 12, 13) for x in rows for y in rows if x["node"] == y["node"] == node and x["key"] < y["key"] and common.first_met(np.ones((2, 2), bool), node, [x["nodes"], y["nodes"]])[0, 1]]
    assert sorted(counted) == [(0, 1), (0, 2), (1, 2), (2, 3), (4, 5), (6, 7)]


def test_embedding_recall_at_the_threshold(spark):
    """Pairs whose cosine is just above the threshold, with the default recall."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(1500):
        x, y = rng.standard_normal((2, 64))
        x /= np.linalg.norm(x)
        y -= (x @ y) * x
        rows += [(2 * k, x.tolist()), (2 * k + 1, (0.901 * x + math.sqrt(1 - 0.901**2) * y / np.linalg.norm(y)).tolist())]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("n_links > 0").count()
    print(f"recall at the threshold: {got / 3000:.4f}")
    assert got >= 0.97 * 3000


def test_components(spark, hot):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000, k) for k in range(1001, 1400)] + [(k, k + 1) for k in range(2000, 2100)] + [(5, 5)]
    want = _classes(3000, edges)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: want[x] for x in nodes} and len(got) == len(nodes)


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/b", "<head><title>t</title></head><p>One &amp; two<p>three<script>no</script>", "x"), (2, None, None, "x"), (None, "http://c", "", "x")], "page_id long, url string, html string, record string")
    rows = warc.derive(warc.responses_of_pages(pages)).collect()
    assert len(rows) == 6
    source = {r["refers_to"] for r in rows}
    assert len(source) == 3 and len({r["record_id"] for r in rows}) == 6
    for r in rows:
        (headers, block), = warc.parse_records(bytes(r["record"]))
        assert headers["warc-refers-to"] == r["refers_to"] and headers["warc-type"] == r["record_type"] and warc.digest(block) == r["block_digest"] and len(block) == r["content_length"]
    one = {r["record_type"]: r for r in rows if r["source_id"] == 1}
    assert one["conversion"]["text"] == "One & two\nthree" and one["conversion"]["payload_digest"] == warc.digest(b"<head><title>t</title></head><p>One &amp; two<p>three<script>no</script>")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX: 1\r\n\r\n<p>hi"
    data = warc.record_bytes({"WARC-Type": "response", "WARC-Record-ID": "<urn:x>", "WARC-Target-URI": "http://q", "WARC-Date": "d"}, block)
    compress = zlib.compressobj(wbits=31)
    (tmp_path / "a.warc.gz").write_bytes((compress.compress(data) + compress.flush()) * 1 + zlib.compress(data, wbits=31))
    (tmp_path / "b.warc").write_bytes(data + data[:-20])
    read = warc.read_responses(spark, str(tmp_path)).collect()
    assert len(read) == 3 and read[0]["payload"] == "<p>hi" and read[0]["http_headers"]["X"] == "1"
    assert {r["refers_to"] for r in warc.derive(warc.read_responses(spark, str(tmp_path))).collect()} == {"<urn:x>"}


def test_html_remainder_of_a_block_has_a_template(spark):
    rows = [(k, "http://h/", f"<body><p>Unmarked line that all pages of this host have</p><p>Body number {k} {f'w{k} ' * 40}</p></body>") for k in range(html_extraction.BLOCK + 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    # One salt of BLOCK + 2 pages, as a busy host of a larger table has.
    found = html_extraction.extract_main_text(pages).collect()
    assert len(found) == len(rows) and [r["page_id"] for r in found if "Unmarked" in r["text"] or f"Body number {r['page_id']} " not in r["text"]] == []


def test_warc_keeps_the_source(spark, tmp_path):
    import gzip

    page = "<p>caf\u00e9 one".encode("latin-1")
    packed = gzip.compress(page)
    bodies = {"<urn:a>": (page, b""), "<urn:b>": (b"%x\r\n%s\r\n0\r\n\r\n" % (len(packed), packed), b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n"), "<urn:c>": (b"\xff\x00\x80", b"")}
    data = b""
    for name, (body, more) in bodies.items():
        block = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nContent-Type: text/html; charset=iso-8859-1\r\n" + more + b"\r\n" + body
        own = {"WARC-Payload-Digest": "md5:own"} if name == "<urn:a>" else {}
        data += warc.record_bytes({"WARC-Type": "response", "WARC-Record-ID": name, "WARC-Target-URI": "http://q", "WARC-Date": "d", "WARC-IP-Address": "192.0.2.9"} | own, block)
    (tmp_path / "a.warc").write_bytes(data)
    read = {r["source_id"]: r for r in warc.read_responses(spark, str(tmp_path)).collect()}
    assert {k: bytes(r["body"]) for k, r in read.items()} == {k: v[0] for k, v in bodies.items()}
    assert [tuple(x) for x in read["<urn:a>"]["http_fields"]][:2] == [("Set-Cookie", "a=1"), ("Set-Cookie", "b=2")] and read["<urn:a>"]["http_headers"]["Set-Cookie"] == "b=2"
    made = {(r["refers_to"], r["record_type"]): r for r in warc.derive(warc.read_responses(spark, str(tmp_path))).collect()}
    for name, (body, _) in bodies.items():
        meta, text = made[name, "metadata"], made[name, "conversion"]
        (headers, block), = warc.parse_records(bytes(meta["record"]))
        lines = block.decode().split("\r\n")
        assert meta["payload_digest"] == text["payload_digest"] == headers["warc-payload-digest"] == ("md5:own" if name == "<urn:a>" else warc.digest(body))
        assert f"sourcePayloadLength: {len(body)}" in lines and {"Set-Cookie: a=1", "Set-Cookie: b=2", "sourceHeader: WARC-IP-Address: 192.0.2.9"} <= set(lines)
        assert name == "<urn:c>" or text["text"] == "caf\u00e9 one"


def test_warc_sets_bad_records_aside(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi"
    good = warc.record_bytes({"WARC-Type": "response", "WARC-Record-ID": "<urn:x>", "WARC-Target-URI": "http://q", "WARC-Date": "d"}, block)
    member = zlib.compress(good, wbits=31)
    damaged = member[:30] + b"\x00\x01\x02\x03\x04" + member[35:]
    (tmp_path / "a.warc.gz").write_bytes(member + damaged + member)
    (tmp_path / "b.warc").write_bytes(good.replace(b"Content-Length: ", b"Content-Length: x") + good + good[:-20])
    (tmp_path / "c.warc").write_bytes(b"")
    read = warc.read_responses(spark, str(tmp_path))
    assert read.count() == 3 and {r["http_status"] for r in read.collect()} == {"HTTP/1.1 200 OK"}
    made = warc.derive(read).where("record_type = 'metadata'").collect()
    assert len(made) == 3 and all(b"sourceStatus: HTTP/1.1 200 OK\r\n" in bytes(r["record"]) for r in made)
    assert sorted(r["reason"] for r in warc.rejected_records(spark, str(tmp_path)).collect()) == ["Content-Length is no number", "block is cut off", "damaged gzip member"]
    assert warc.derive(read.limit(0)).count() == 0


def test_op10_makes_records(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {(r["source_id"], r["record_type"]): bytes(r["record"]) for r in warc.derive(warc.responses_of_pages(pages)).collect()}
    for r in queries.op10_warc(spark, SF).collect():
        record = want[r["page_id"], r["record_type"]]
        assert (r["record_length"], r["record_sha256"]) == (len(record), hashlib.sha256(record).hexdigest()) and next(warc.parse_records(record))[0]["warc-record-id"] == r["record_id"]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tok, kept = Tokenizer.from_file(BPE), {}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        judged = quality_rules.judge(r["text"])
        if judged[6]:
            kept[r["doc_id"]] = judged[8]
    quality = corpus_pipeline.quality(spark, docs, SF)
    assert {r["doc_id"]: r["text"] for r in quality.collect()} == kept and quality.columns == docs.columns
    language = corpus_pipeline.language(spark, quality, SF)
    assert language.columns == docs.columns and language.count() == len(kept)  # all have letters, and a language
    ids, sets = sorted(kept), [_sets(kept[i]) for i in sorted(kept)]
    classes = _classes(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    left = {ids[c] for c in set(classes)}
    _check_packing(corpus_pipeline.run(spark, SF).collect(), {i: [*tok.encode(kept[i], add_special_tokens=False).ids, 0] for i in left})
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES]) == '["quality_rules", "language_id", "jaccard_join", "packing"]'
