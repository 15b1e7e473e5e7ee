"""Derivatives of WARC responses: linked metadata and plain-text conversion records.

Each response gives two records that name it in WARC-Refers-To and repeat its target, date and payload digest: one of type metadata, with
the source's WARC and HTTP headers and measures of its payload, and one of type conversion, with the visible text of an HTML payload.
Payloads are bytes and headers are lists of (name, value) in the source's order; a payload is decoded for its text only.
"""

from __future__ import annotations

import base64
import hashlib
import html as html_lib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_HIDDEN = re.compile(r"<!--|<(script|style|head|noscript|template|textarea|svg)\b[^<>]*>", re.I)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"<[/!a-zA-Z?][^>]*(?:>|\Z)")
_SPACE = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(data: bytes) -> str:
    """sha1: and the digest in base 32, as WARC files write it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _shown(html: str) -> str:
    """A page without comments, scripts and what else is not shown; one that is not closed goes on to the end. Linear: each end is looked for from where its start is."""
    out, at = [], 0
    while m := _HIDDEN.search(html, at):
        close = m[1] and re.compile(rf"</{m[1]}\s*>", re.I).search(html, m.end())
        end = close.end() if close else len(html)
        if not m[1]:
            end = html.find("-->", m.end()) + 3 if html.find("-->", m.end()) >= 0 else len(html)
        out.append(html[at : m.start()])
        at = end
    return " ".join([*out, html[at:]])


def visible_text(html: str) -> str:
    """The text of a page as lines: all that is not markup, script, style or head, references decoded, white space collapsed."""
    text = _TAG.sub("", _BREAK.sub("\n", _shown(html.replace("\n", " "))))
    return _LINES.sub("\n", _SPACE.sub(" ", html_lib.unescape(text).replace("\xa0", " "))).strip()


def record_id(*parts: str) -> str:
    """A urn:uuid that depends on the parts alone, so that a task that runs twice writes the same record."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    """A WARC/1.0 record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return b"WARC/1.0\r\n" + head.encode("utf-8") + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


_CHARSET = re.compile(r"""charset\s*=\s*["']?\s*([\w.:-]+)""", re.I)
FIELDS = "array<struct<name:string,value:string>>"


def _unchunked(data: bytes) -> bytes:
    """The body of a chunked transfer; data as it stands if it is not chunked, as when the crawler has joined the chunks."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0 and re.fullmatch(rb"[0-9a-fA-F]{1,16}", size := data[at:end].partition(b";")[0].strip()):
        if not (n := int(size, 16)):
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out) if out and at >= len(data) else data


def _inflated(data: bytes, coding: str) -> bytes:
    """The content of a gzip or deflate coding, as far as it can be read; data as it stands if it is not so coded."""
    for bits in (47,) if coding.endswith("gzip") else (15, -15):
        out, left = [], data
        try:
            while left:
                z = zlib.decompressobj(bits)
                out += [z.decompress(left), z.flush()]
                left = z.unused_data
            return b"".join(out)
        except zlib.error:
            if any(out):
                return b"".join(out)
    return data


def payload_text(payload: bytes, http: str = "") -> str:
    """The characters of a payload under its HTTP header lines: transfer and content codings undone, then the charset of the header, a byte order mark, the document or UTF-8.

    Content codings other than gzip and deflate (the standard library has no br or zstd) give no text.
    """
    codings = {"transfer-encoding": [], "content-encoding": []}
    kind = ""
    for line in http.split("\r\n"):
        name, _, value = line.partition(":")
        if (name := name.strip().lower()) in codings:
            codings[name] += [x for y in value.lower().split(",") if (x := y.strip()) and x != "identity"]
        elif name == "content-type":
            kind = value
    data = _unchunked(payload) if "chunked" in codings["transfer-encoding"] else payload
    for coding in reversed(codings["content-encoding"]):
        if coding not in ("gzip", "x-gzip", "deflate"):
            return ""
        data = _inflated(data, coding)
    marks = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
    named = next((c for m, c in marks if data.startswith(m)), None) or next((m[1] for x in (kind, data[:1024].decode("latin-1")) if (m := _CHARSET.search(x))), "utf-8")
    try:
        return data.decode("cp1252" if named.lower() in ("iso-8859-1", "latin-1", "latin1", "ascii", "us-ascii") else named, "replace")  # as browsers read them
    except (LookupError, ValueError):
        return data.decode("utf-8", "replace")


def responses_of_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response rows (source_id, target_uri, date, http_fields, body) of a table of fetched pages; null html is an empty payload."""
    length = F.octet_length(F.coalesce(html_col, F.lit(""))).cast("string")
    fields = F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in (("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", length))])
    return pages.select(F.col(id_col).alias("source_id"), F.col(url_col).alias("target_uri"), F.lit(date).alias("date"), fields.alias("http_fields"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("body"))


def _lines(fields: Column, before: str = "") -> Column:
    return F.array_join(F.transform(fields, lambda e: F.concat(F.lit(before), e["name"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\r\n")


def derive(responses: DataFrame, with_record: bool = True) -> DataFrame:
    """Two rows for each row of responses, of record_type metadata and conversion.

    responses has source_id, target_uri, date, body (binary) and http_fields (array of name and value), or in their place payload (text) and
    http_headers (map). Where it has them, record_id, payload_digest and warc_fields are the source's own and are kept; a missing digest is
    worked out from the body's bytes. The source's WARC headers go into the metadata record as lines of the field sourceHeader, its HTTP status line
    (http_status) as sourceStatus.

    Columns: source_id, record_type, record_id, refers_to, target_uri, date, content_type, payload_digest (of the source), block_digest, content_length,
    text (of a conversion), and record, the bytes of the WARC record, if with_record. record_id of the source, if responses has no such column, is
    made of its target, date and payload digest and its source_id, so repeated rows give equal records. A null target leaves that header out; a null payload counts as
    empty, and its conversion has an empty text. Other columns are not read; an empty table gives no rows. Row by row, without a shuffle.
    """
    given = set(responses.columns)
    none = F.lit(None).cast("string")
    kind = dict(responses.dtypes)["source_id"]
    entries = F.col("http_fields") if "http_fields" in given else F.transform(F.map_entries("http_headers"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    rows = responses.select(
        "source_id", *[(F.col(c) if c in given else none).alias(f"_{c}") for c in ("record_id", "payload_digest")], "target_uri", "date", _lines(entries).alias("_http"),
        F.concat_ws("\r\n", _lines(F.col("warc_fields"), "sourceHeader: ") if "warc_fields" in given else none, F.concat(F.lit("sourceStatus: "), F.col("http_status")) if "http_status" in given else none).alias("_warc"), F.col("body" if "body" in given else "payload").cast("binary").alias("_body"),
    )
    schema = (
        f"source_id {kind}, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, payload_digest string, block_digest string,"
        " content_length long, text string" + ", record binary" * with_record
    )
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                out = []
                for i, own, source_digest, target, date, http, warc, data in batch.iloc[at : at + 1000].itertuples(index=False, name=None):
                    own, source_digest, target, date, http, warc, data = (None if x is None or x != x else x for x in (own, source_digest, target, date, http, warc, data))
                    data = bytes(data or b"")
                    source_digest = source_digest or digest(data)
                    own = own or record_id("response", str(i), target or "", date or "", source_digest)
                    text = visible_text(payload_text(data, http or ""))
                    described = f"sourcePayloadLength: {len(data)}\r\nsourcePayloadDigest: {source_digest}\r\nconversionCharacters: {len(text)}\r\n" + "".join(x + "\r\n" for x in (warc, http) if x)
                    for record_type, content_type, block in (("metadata", "application/warc-fields", described.encode("utf-8")), ("conversion", "text/plain", text.encode("utf-8"))):
                        name, block_digest = record_id(record_type, own), digest(block)
                        row = (i, record_type, name, own, target, date, content_type, source_digest, block_digest, len(block), text if record_type == "conversion" else None)
                        if with_record:
                            headers = {
                                "WARC-Type": record_type, "WARC-Record-ID": name, "WARC-Refers-To": own, "WARC-Target-URI": target, "WARC-Date": date, "Content-Type": content_type,
                                "WARC-Payload-Digest": source_digest, "WARC-Block-Digest": block_digest,
                            }
                            row += (record_bytes(headers, block),)
                        out.append(row)
                yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, schema)


#: Compressed bytes that are inflated at a time.
SLICE = 1 << 16


def _members(data: bytes) -> Iterator[tuple[int, bytes | None]]:
    """(offset, content) of a file that is plain, or a chain of gzip members; None for a member that can't be read, after which the next one's mark is looked for. Linear in the file's size."""
    if data[:2] != b"\x1f\x8b":
        yield 0, data
        return
    at, view = 0, memoryview(data)
    while data[at : at + 2] == b"\x1f\x8b":
        z, out, end = zlib.decompressobj(31), [], at
        try:
            while not z.eof:
                if not (some := view[end : end + SLICE]):
                    raise zlib.error("cut off")
                out.append(z.decompress(some))
                end += len(some)
            yield at, b"".join(out)
            at = end - len(z.unused_data)
        except zlib.error:
            yield at, None
            at = data.find(b"\x1f\x8b\x08", at + 1)
            if at < 0:
                return


def _fields(lines: list[str]) -> list[tuple[str, str]]:
    """(name, value) of header lines in their order; a line that starts with white space goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        elif line.strip():
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def scan(data: bytes) -> Iterator[tuple[int, list[tuple[str, str]], bytes, str | None]]:
    """(offset of the gzip member or record, headers as a list of name and value, block, reason) of the records of a WARC file; reason, null for a good record, says why one is set aside."""
    for offset, member in _members(data):
        if member is None:
            yield offset, [], b"", "damaged gzip member"
            continue
        at, plain = 0, member is data
        while (start := member.find(b"WARC/1.", at)) >= 0:
            here = start if plain else offset
            if (end := member.find(b"\r\n\r\n", start)) < 0:
                yield here, [], b"", "headers are cut off"
                break
            fields = _fields(member[start:end].decode("utf-8", "replace").split("\r\n")[1:])
            size = next((v for k, v in reversed(fields) if k.lower() == "content-length"), "")
            if not (size.isascii() and size.isdigit()):
                yield here, fields, b"", "Content-Length is no number"
                at = end + 4
                continue
            block = member[end + 4 : end + 4 + int(size)]
            if len(block) < int(size):
                yield here, fields, b"", "block is cut off"
                break
            yield here, fields, block, None
            at = end + 4 + int(size)


def parse_fields(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers as a list of name and value, block) of the good records of a WARC file."""
    for _, fields, block, reason in scan(data):
        if reason is None:
            yield fields, block


def rejected_records(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows (path, position, reason) of what read_responses() sets aside: damaged gzip members, and records cut off or without a length."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(path, at, reason) for path, content in batch.itertuples(index=False, name=None) for at, _, _, reason in scan(bytes(content)) if reason]
            yield pd.DataFrame(found, columns=["path", "position", "reason"])

    return files.mapInPandas(run, "path string, position long, reason string")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of the records of a WARC file; of a repeated header the last."""
    for fields, block in parse_fields(data):
        yield {k.lower(): v for k, v in fields}, block


def read_responses(spark: SparkSession, *paths: str) -> DataFrame:
    """Response rows, as derive() takes them, of WARC files, plain or gzipped; source_id is the record id.

    Records that can't be read are left out; rejected_records() names them. body has the payload's bytes and payload_digest the source's own digest (null if it gives none); warc_fields and http_fields have all headers
    in order, repeated ones too. payload (the body as UTF-8) and http_headers (a map, of a repeated header the last) are worked out only if read.
    A file is one row of Spark's binaryFile source, so it must be smaller than 2 GB; files are read in parallel.
    """
    files = spark.read.format("binaryFile").load(list(paths)).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                out = []
                for fields, block in parse_fields(bytes(content)):
                    headers = {k.lower(): v for k, v in fields}
                    if headers.get("warc-type") != "response":
                        continue
                    head, _, body = block.partition(b"\r\n\r\n")
                    status, *lines = head.decode("latin-1").split("\r\n")
                    http = _fields(lines)
                    named = ([{"name": k, "value": v} for k, v in x] for x in (fields, http))
                    out.append((*(headers.get(k) for k in ("warc-record-id", "warc-record-id", "warc-target-uri", "warc-date", "warc-payload-digest")), *named, status, body))
                    if len(out) >= 500:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=names)

    names = ["source_id", "record_id", "target_uri", "date", "payload_digest", "warc_fields", "http_fields", "http_status", "body"]
    rows = files.mapInPandas(run, f"source_id string, record_id string, target_uri string, date string, payload_digest string, warc_fields {FIELDS}, http_fields {FIELDS}, http_status string, body binary")
    http = F.col("http_fields")
    last = F.filter(http, lambda e, k: ~F.exists(F.slice(http, k + 2, F.size(http)), lambda x: x["name"] == e["name"]))
    return rows.withColumn("payload", F.make_valid_utf8(F.col("body").cast("string"))).withColumn("http_headers", F.map_from_entries(last))
