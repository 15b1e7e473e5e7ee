from __future__ import annotations

import base64
import hashlib
import time
import uuid

import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from chatlake.llm import bpe, packing, queries, token_counts, warc
from conftest import SF

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_empty_tables_give_empty_results(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert token_counts.count_tokens(none, PIECES).collect() == packing.pack(none, BPE).collect() == bpe.bpe_round_trip(none, BPE).collect() == []
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def _digest(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_records_of_all_pages_by_another_way(spark):
    """The bytes of each record, put together from the page alone, against the digests and lengths that the query returns."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas()
    got = {(r["page_id"], r["record_type"]): r for r in queries.queries()["op10_warc"](spark, SF).collect()}
    assert len(got) == 2 * len(pages)
    for i, url, html in pages[["page_id", "url", "html"]].itertuples(index=False):
        body = ("" if html is None else html).encode()
        source = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(['response', str(i), url or '', '2024-01-01T00:00:00Z', _digest(body)]))}>"
        text = warc.visible_text(body.decode())
        described = f"sourcePayloadLength: {len(body)}\r\nsourcePayloadDigest: {_digest(body)}\r\nconversionCharacters: {len(text)}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n"
        for kind, content, block in (("metadata", "application/warc-fields", described.encode()), ("conversion", "text/plain", text.encode())):
            r = got[i, kind]
            name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join([kind, source]))}>"
            lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Refers-To: {source}", *([f"WARC-Target-URI: {url}"] if url is not None else []), "WARC-Date: 2024-01-01T00:00:00Z", f"Content-Type: {content}"]
            lines += [f"WARC-Payload-Digest: {_digest(body)}", f"WARC-Block-Digest: {_digest(block)}", f"Content-Length: {len(block)}", "", ""]
            record = "\r\n".join(lines).encode() + block + b"\r\n\r\n"
            assert (r["record_id"], r["refers_to"], r["content_length"], r["record_length"], r["record_sha256"]) == (name, source, len(block), len(record), hashlib.sha256(record).hexdigest())


def test_reading_many_members_takes_time_in_proportion(spark, tmp_path):
    import gzip

    record = warc.record_bytes({"WARC-Type": "response", "WARC-Record-ID": "<urn:a>", "WARC-Target-URI": "http://a/"}, b"HTTP/1.1 200 OK\r\n\r\n<p>" + hashlib.sha512(b"x").hexdigest().encode() * 100)
    member = gzip.compress(record, 0)
    start = time.time()
    assert sum(1 for _ in warc.scan(member * 8000)) == 8000 and time.time() - start < 20
    start = time.time()
    assert warc.visible_text("<script " * 50_000 + "<style>" * 50_000 + "<!--" * 50_000) is not None and time.time() - start < 20
    (tmp_path / "a.warc.gz").write_bytes(member * 50)
    read = warc.read_responses(spark, str(tmp_path))
    made = warc.derive(read)
    assert read.count() == 50 and made.count() == 100 and made.where("record_type = 'conversion'").select(F.length("text")).distinct().count() == 1
    assert pd.Series([r["refers_to"] for r in made.collect()]).unique().tolist() == ["<urn:a>"]
