from __future__ import annotations

import glob
import hashlib
import json
import math
import os
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chatlake.llm import collocations, importance, queries, records
from conftest import SF

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, row long, _in boolean, key string, n long, id string, bits long"
LONG = "word other, " * 30_000


def table(spark, texts, langs=None, ids=None):
    rows = [((ids or range(len(texts)))[k], t, (langs or ["en"] * len(texts))[k], 5, None, "k", 9, "q", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_draw(texts, target, percent, min_words, buckets, longest, ids):
    def crcs(text):
        w = words_of(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    each = [crcs(t) for t in texts]
    s, t = Counter(b for x in each for b in x), Counter(b for x in target for b in crcs(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)}
    rows = []
    for i, text, x in zip(ids, texts, each, strict=True):
        u = (int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        weight = sum(gain[b] for b in x) // len(x) if x else 0
        rows.append([i, len(words_of(text)), len(x), weight, weight + math.floor(-1000 * math.log(-math.log(u))), None])
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=repr)


ODD = [None, "", " ,;. ", "Ab ab\tAB!", "é日本 x\x00y \x7f z9", "same text again " * 9, "same text again " * 9, "x" * 5000, LONG, "The quick-brown_fox 12%3 of it"]


def test_draw_equals_brute_force(spark):
    target = ["the quick brown fox", None, "same text", ""]
    for longest, buckets, percent, least in ((2, 10_000, 50, 1), (3, 97, 34, 0), (1, 70_000, 100, 3)):
        out = importance.resample(table(spark, ODD), table(spark, target), percent=percent, min_words=least, buckets=buckets, max_words=longest)
        assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, out.collect()), key=repr) == brute_draw(ODD, target, percent, least, buckets, longest, list(range(len(ODD))))


def test_draw_of_whole_tables_equals_brute_force(spark):
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet").toPandas() for t in ("documents", "benchmark"))
    found = queries.queries()["op11_importance_resampling"](spark, SF)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_draw(docs["text"].tolist(), target["text"].tolist(), 25, 20, 10_000, 2, docs["doc_id"].tolist())


def test_draw_of_repeats_nulls_and_nothing(spark):
    same = table(spark, ["one two three"] * 8, ids=[1] * 4 + [None] * 4)
    out = importance.resample(same, table(spark, []), percent=50, min_words=3)
    assert sorted(r["rank"] for r in out.collect() if r["rank"]) == [1, 2, 3, 4]  # each row counts, also of equal ids and scores
    assert len({r["score"] for r in out.where("doc_id is null").collect()}) == 1
    assert importance.resample(table(spark, []), table(spark, ["a"])).count() == 0


def brute_phrases(rows, least, longest):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                count[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return {lang: {p: n for p, n in c.items() if n >= least} for lang, c in count.items()}, total


def brute_collocations(rows, least=100, longest=5, top=2000, subsumed=100):
    frequent, total = brute_phrases(rows, least, longest)
    out = []
    for lang, f in frequent.items():
        scored = []
        for p, a in f.items():
            if len(p) < 2 or any(len(q) > len(p) and 100 * b >= subsumed * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in f.items()):
                continue
            score, _, l, r = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, total[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


PHRASES = ["New York City, new york city", "the new\tyork CITY. of new york city", "a b c d e f a b c d e f; a b c d e f", None, "", " .,\n ", "é ü é ü é ü\x85x é ü", "a b" * 3, "x " * 4000 + ".", "new york city"] * 3


@pytest.mark.parametrize("options", [{"sample": 0.0}, {"sample": 1.0, "max_words": 3}, {"filter_bits": 64}, {"sample": 0.3, "subsumed": 60, "top": 5}])
def test_collocations_equal_brute_force(spark, options):
    langs = [("en", "de", None)[k % 3] for k in range(len(PHRASES))]
    docs = table(spark, PHRASES, langs)
    out = collocations.collocations(docs, min_count=3, **{"sample": 0.5} | options)
    want = brute_collocations(list(zip(langs, PHRASES, strict=True)), 3, options.get("max_words", 5), options.get("top", 2000), options.get("subsumed", 100))
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, out.collect())) == want and want


def test_collocations_in_chunks_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SEGMENT", 50)
    text = "one two three, " * 400 + "no end " * 300
    ids, words = next(collocations._chunks([pd.DataFrame({"lang": ["en"], "text": [text]})]))
    found = {}
    for _, _, counts, parts in collocations.count_chunk(ids, words, None, 5):
        langs, phrases = collocations.spelled(parts, words, np.arange(len(counts)))
        found |= dict(zip(phrases, counts.tolist(), strict=True))
    assert found == {" ".join(p): n for p, n in brute_phrases([("en", text)], 1, 5)[0]["en"].items()}


def test_collocations_of_nothing(spark):
    for texts in ([], [None, "", "a b c"]):
        assert collocations.collocations(table(spark, texts)).count() == 0


def test_large_counts_are_exact(spark):
    big = 2**61
    row = spark.sql(f"SELECT CAST({big} AS DECIMAL(19,0)) AS a, CAST({big - 1} AS DECIMAL(19,0)) AS b").selectExpr("a * b AS p").first()
    assert int(row.p) == big * (big - 1)


@pytest.fixture
def written(spark, tmp_path):
    docs = table(spark, [*ODD, "don't <|endoftext|> x"], ids=[3, 1, 2, None, 7, 7, 7, 0, 9, -4, 8])
    folder = str(tmp_path / "records")
    records.write_documents(docs, BPE, folder)
    return docs, folder


def ids_of(text):
    return [*Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids, 2]


def test_records_round_trip(spark, tmp_path):
    docs = table(spark, [*ODD, "don't <|endoftext|> x"], ids=[3, 1, 2, None, 7, 7, 7, 0, 9, -4, 8])
    out = records.round_trip(docs, BPE, str(tmp_path / "r"))
    got = sorted(map(tuple, out.collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, -4, 0, 1, 2, 3, 7, 7, 7, 8, 9]
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    want = Counter((r.doc_id, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r in docs.collect() for x in [ids_of(r.text)])
    assert Counter((r[0], r[2], r[3]) for r in got) == want
    assert records.round_trip(table(spark, []), BPE).count() == 0


def test_records_of_whole_table_equal_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    tok, start, want = Tokenizer.from_file(BPE), 0, []
    for d in docs:
        x = [*tok.encode(d.text or "", add_special_tokens=False).ids, 2]
        want.append((d.doc_id, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert sorted(map(tuple, queries.queries()["op13_token_records"](spark, SF).collect())) == want


def test_records_are_framed_as_documented(written):
    """Read without the module: lengths, checksums by a bitwise loop, and the index."""

    def masked(data):
        crc = 0xFFFFFFFF
        for byte in data:
            crc ^= byte
            for _ in range(8):
                crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
        crc ^= 0xFFFFFFFF
        return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF

    _, folder = written
    shards = json.load(open(f"{folder}/manifest.json"))
    assert sum(s["records"] for s in shards) == 11 and {s["shard"] for s in shards} == {os.path.basename(x)[:-8] for x in glob.glob(f"{folder}/*.records")}
    for s in shards:
        data, index = open(f"{folder}/{s['shard']}.records", "rb").read(), open(f"{folder}/{s['shard']}.index", "rb").read()
        at = tokens = 0
        for k in range(s["records"]):
            assert struct.unpack_from("<QQ", index, 16 * k) == (at, tokens)
            (size,) = struct.unpack_from("<Q", data, at)
            payload = data[at + 12 : at + 12 + size]
            assert struct.unpack_from("<I", data, at + 8)[0] == masked(data[at : at + 8])
            if size < 20_000:
                assert struct.unpack_from("<I", data, at + 12 + size)[0] == masked(payload)
            at, tokens = at + 16 + size, tokens + (size - 9) // 2
        assert struct.unpack_from("<QQ", index, 16 * s["records"]) == (at, tokens) and at == len(data) and tokens == s["tokens"]


def test_shuffled_reads_give_all_records_in_an_order_of_the_seed(spark, written):
    _, folder = written
    plain = records.read_records(spark, folder).collect()
    one, same, other = ([tuple(r) for r in records.read_shuffled(spark, folder, seed).collect()] for seed in (1, 1, 2))
    assert one == same != other
    assert Counter(map(tuple, plain)) == Counter(one) == Counter(other)


def test_appended_and_replaced_records(spark, written):
    docs, folder = written
    before = records.read_records(spark, folder).agg(F.sum("n_tokens"), F.count("*")).first()
    records.write_documents(docs, BPE, folder, mode="append")
    both = records.read_records(spark, folder)
    assert tuple(both.agg(F.sum("n_tokens"), F.count("*")).first()) == (2 * before[0], 2 * before[1])
    assert both.select("start").distinct().count() == both.count()
    records.write_documents(docs.limit(2), BPE, folder)
    assert records.read_records(spark, folder).count() == 2
    assert len(glob.glob(f"{folder}/*.records")) == len(json.load(open(f"{folder}/manifest.json")))


@pytest.mark.parametrize("place", [0, 9, 14, -2])
def test_damaged_records_are_found(spark, written, place):
    _, folder = written
    shard = max(glob.glob(f"{folder}/*.records"), key=os.path.getsize)
    data = bytearray(open(shard, "rb").read())
    data[place] ^= 4
    open(shard, "wb").write(data)
    with pytest.raises(Exception, match="damaged"):
        records.read_records(spark, folder).collect()


def test_vocabularies_of_over_two_bytes(spark, tmp_path):
    ids = np.array([1, 70_000, 2**31], "<u4").tobytes()
    records.write_records(spark.createDataFrame([(5, bytearray(ids), True)], "id long, ids binary, wide boolean"), str(tmp_path / "w"))
    (row,) = records.read_records(spark, str(tmp_path / "w")).collect()
    assert (row.id, row.start, row.n_tokens, bytes(row.ids)) == (5, 0, 3, ids)
