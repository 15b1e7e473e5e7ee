"""Token ids as length-delimited binary records in shards, with an offset index beside each shard for shuffled reads.

A record is its payload's length (8 bytes), a masked CRC-32C of those, the payload, and a masked CRC-32C of it, all little-endian: the framing
that TFRecord files have. The payload of a document is one byte of flags, its id in 8 bytes and its token ids, of two bytes each where the vocabulary
allows. A shard's index has, for each record and for the end, the record's offset and the number of token ids before it in the shard, in 8 bytes
each. A manifest, written last, names the shards in order and the ids before each; shards that it does not name do not exist.

Spark writes and reads the files by a data source: a task writes one shard under a name of its own, so a task that runs twice does no harm.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from chatlake.llm import packing
from chatlake.llm.common import bound_batches, shared_dir

END_ID, MANIFEST = 2, "manifest.json"
#: Records, and bytes of payload, that are framed or checked together.
GROUP, GROUP_BYTES = 250, 8 << 20
#: Fixed values of the framing: the reflected polynomial of CRC-32C, and the constant of its mask.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
#: Bytes that a checksum takes at a time, for many records at once.
WIDTH = 256
HAS_ID, WIDE = 1, 2
SCHEMA = "id long, start long, n_tokens long, ids binary"
INDEX_SCHEMA = "shard string, record long, offset long, length long, start long"


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The table of one byte, and for each of four bytes of a checksum what it becomes WIDTH zero bytes later."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1).astype(np.uint32)
    later = np.array([[k << 8 * byte for k in range(256)] for byte in range(4)], np.uint32)
    for _ in range(WIDTH):
        later = one[later & 255] ^ (later >> 8)
    return one, later


def _masked(crc: np.ndarray) -> np.ndarray:
    crc = ~crc.astype(np.uint32)
    return ((crc >> 15) | (crc << 17)) + np.uint32(MASK)


def masked_of_rows(rows: np.ndarray) -> np.ndarray:
    """Masked CRC-32C of each row of a matrix of bytes."""
    one, _ = _tables()
    state = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        state = one[(state ^ column) & 255] ^ (state >> 8)
    return _masked(state)


def masked_of(payloads: list[bytes]) -> np.ndarray:
    """Masked CRC-32C of each payload of at least 4 bytes.

    Payloads are cut into blocks of WIDTH bytes from their ends, all blocks are run through together, and a payload's blocks are then put
    together; zeros before a payload change nothing, as its first four bytes carry the initial value.
    """
    one, later = _tables()
    sizes = np.array([len(p) for p in payloads], np.int64)
    blocks = -(-sizes // WIDTH)
    ends = np.cumsum(blocks)
    flat = np.zeros(int(ends[-1]) * WIDTH if len(ends) else 0, np.uint8)
    for data, size, end in zip(payloads, sizes.tolist(), (ends * WIDTH).tolist(), strict=True):
        flat[end - size : end] = np.frombuffer(data, np.uint8)
        flat[end - size : end - size + 4] ^= 255
    state = np.zeros(len(flat) // WIDTH, np.uint32)
    for column in np.ascontiguousarray(flat.reshape(-1, WIDTH).T):
        state = one[(state ^ column) & 255] ^ (state >> 8)
    first, crc = ends - blocks, np.zeros(len(payloads), np.uint32)
    for k in range(int(blocks.max(initial=0))):
        on = np.flatnonzero(blocks > k)
        c = crc[on]
        crc[on] = later[0][c & 255] ^ later[1][c >> 8 & 255] ^ later[2][c >> 16 & 255] ^ later[3][c >> 24] ^ state[first[on] + k]
    return _masked(crc)


def framed(payloads: list[bytes]) -> list[bytes]:
    lengths = np.array([len(p) for p in payloads], "<u8")
    heads = masked_of_rows(lengths.view(np.uint8).reshape(-1, 8)).astype("<u4")
    tails = masked_of(payloads).astype("<u4")
    return [n.tobytes() + h.tobytes() + p + t.tobytes() for n, h, p, t in zip(lengths, heads, payloads, tails, strict=True)]


def unframed(records: list[bytes]) -> list[bytes]:
    """The payloads of whole records; ValueError if a length or checksum is wrong."""
    heads = np.frombuffer(b"".join(r[:12] for r in records), np.uint8).reshape(-1, 12)
    payloads = [r[12:-4] for r in records]
    lengths = np.ascontiguousarray(heads[:, :8]).view("<u8").ravel()
    if not np.array_equal(masked_of_rows(heads[:, :8]), np.ascontiguousarray(heads[:, 8:]).view("<u4").ravel()) or lengths.tolist() != [len(p) for p in payloads]:
        raise ValueError("damaged length of a record")
    if not np.array_equal(masked_of(payloads), np.frombuffer(b"".join(r[-4:] for r in records), "<u4")):
        raise ValueError("damaged payload of a record")
    return payloads


def payload(key: int | None, ids: bytes, wide: bool) -> bytes:
    return struct.pack("<Bq", (key is not None) * HAS_ID + wide * WIDE, key or 0) + ids


def parsed(data: bytes) -> tuple[int | None, np.ndarray]:
    flags, key = struct.unpack_from("<Bq", data)
    return key if flags & HAS_ID else None, np.frombuffer(data, "<u4" if flags & WIDE else "<u2", offset=9)


def _store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def _manifest(folder: str) -> list[dict]:
    store, base = _store(folder)
    with store.open_input_stream(f"{base}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    part: int
    shard: str
    records: int
    tokens: int


class Writer(DataSourceArrowWriter):
    """Rows (id, ids, wide) in the order of partitions and rows; ids are packed, of 4 bytes each if wide, else of 2."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        part = TaskContext.get().partitionId()
        shard = f"part-{part:06d}-{uuid.uuid4().hex}"
        store, base = _store(self.folder)
        store.create_dir(base, recursive=True)
        offset = tokens = records = 0
        with store.open_output_stream(f"{base}/{shard}.records", buffer_size=1 << 20) as out, store.open_output_stream(f"{base}/{shard}.index", buffer_size=1 << 16) as index:
            for batch in batches:
                keys, ids, wide = (batch.column(c).to_pylist() for c in ("id", "ids", "wide"))
                at = 0
                while at < len(keys):
                    end, held = at, 0
                    while end < len(keys) and end - at < GROUP and held < GROUP_BYTES:
                        held += len(ids[end])
                        end += 1
                    made = framed([payload(k, x, w) for k, x, w in zip(keys[at:end], ids[at:end], wide[at:end], strict=True)])
                    for k, record in enumerate(made, at):
                        index.write(struct.pack("<QQ", offset, tokens))
                        offset, tokens = offset + len(record), tokens + len(ids[k]) // (4 if wide[k] else 2)
                        out.write(record)
                    records, at = records + len(made), end
            index.write(struct.pack("<QQ", offset, tokens))
        return Written(part, shard, records, tokens)

    def commit(self, messages: list) -> None:
        store, base = _store(self.folder)
        store.create_dir(base, recursive=True)
        there = _manifest(self.folder) if store.get_file_info(f"{base}/{MANIFEST}").type == pyarrow.fs.FileType.File else []
        shards = [] if self.overwrite else list(there)
        start = shards[-1]["start"] + shards[-1]["tokens"] if shards else 0
        for m in sorted(messages, key=lambda m: m.part):
            shards.append({"shard": m.shard, "records": m.records, "tokens": m.tokens, "start": start})
            start += m.tokens
        part = f"{base}/.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(json.dumps(shards).encode())
        store.move(part, f"{base}/{MANIFEST}")
        self._drop([x["shard"] for x in there] if self.overwrite else [])

    def abort(self, messages: list) -> None:
        self._drop([m.shard for m in messages if m is not None])

    def _drop(self, shards: list[str]) -> None:
        store, base = _store(self.folder)
        for name in (f"{base}/{x}.{kind}" for x in shards for kind in ("records", "index")):
            store.delete_file(name)


@dataclass
class Shard(InputPartition):
    shard: str
    records: int
    start: int


class Reader(DataSourceReader):
    """A partition for each shard: all records in order, or with `index` where each lies."""

    def __init__(self, folder: str, index: bool):
        self.folder, self.index = folder, index

    def partitions(self) -> list[Shard]:
        return [Shard(x["shard"], x["records"], x["start"]) for x in _manifest(self.folder) if x["records"]] or [Shard("", 0, 0)]

    def read(self, one: Shard) -> Iterator[pa.RecordBatch]:
        if one.records:
            yield from (self._index if self.index else self._records)(one)

    def _records(self, one: Shard) -> Iterator[pa.RecordBatch]:
        store, base = _store(self.folder)
        path = f"{base}/{one.shard}.records"
        seen, start, left = 0, one.start, store.get_file_info(path).size
        with store.open_input_stream(path, buffer_size=1 << 20) as f:
            while seen < one.records:
                some, held = [], 0
                while seen < one.records and len(some) < GROUP and held < GROUP_BYTES:
                    head = f.read(12)
                    size = struct.unpack("<Q", head[:8])[0] if len(head) == 12 else left
                    left -= size + 16
                    if left < 0:
                        raise ValueError(f"damaged length of record {seen} of {one.shard}")
                    some.append(head + f.read(size + 4))
                    held, seen = held + size, seen + 1
                batch = _batch(some, None)
                starts = start + np.cumsum([0, *batch[2][:-1]])
                start = int(starts[-1]) + batch[2][-1]
                yield pa.RecordBatch.from_arrays([pa.array(batch[0], pa.int64()), pa.array(starts, pa.int64()), pa.array(batch[2], pa.int64()), pa.array(batch[3], pa.binary())], ["id", "start", "n_tokens", "ids"])

    def _index(self, one: Shard) -> Iterator[pa.RecordBatch]:
        store, base = _store(self.folder)
        with store.open_input_stream(f"{base}/{one.shard}.index") as f:
            at, last = 0, f.read(16)
            while at < one.records:
                more = f.read(16 * min(65_536, one.records - at))
                entries = np.frombuffer(last + more, "<u8").reshape(-1, 2).astype(np.int64)
                n = len(entries) - 1
                columns = [pa.array([one.shard] * n), pa.array(np.arange(at, at + n)), pa.array(entries[:-1, 0]), pa.array(np.diff(entries[:, 0])), pa.array(entries[:-1, 1] + one.start)]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "record", "offset", "length", "start"])
                at, last = at + n, more[-16:]


def _batch(records: list[bytes], starts: list[int] | None) -> tuple[list, list | None, list, list]:
    """(ids, starts, numbers of token ids, token ids of 4 bytes each) of records."""
    rows = [parsed(p) for p in unframed(records)]
    return [k for k, _ in rows], starts, [len(x) for _, x in rows], [x.astype("<u4").tobytes() for _, x in rows]


class TokenRecords(DataSource):
    """The data source `token_records`: path, and index=true to read where records lie instead of the records."""

    @classmethod
    def name(cls) -> str:
        return "token_records"

    def schema(self) -> str:
        return INDEX_SCHEMA if self._index() else SCHEMA

    def _index(self) -> bool:
        return self.options.get("index", "false").lower() == "true"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self._index())

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def placed(rows: DataFrame, id_col: str) -> DataFrame:
    """rows in ascending order of id (null first; ties as Spark reads them), dealt by range and sorted. The row's number keeps even one id of many rows from being one partition. Reads its input twice."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    return numbered.repartitionByRange(n, id_col, "_row").sortWithinPartitions(id_col, "_row").drop("_row")


def encoded(documents: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Rows (id, ids, wide) of rows (id, text), in their order: the packed token ids of each whole text, without added special tokens, then end_id."""
    bound_batches(documents.sparkSession)
    wide = packing._encoder(path)[1].itemsize > 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, kind = packing._encoder(path)
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            for at in range(0, len(batch), GROUP):
                some = batch.iloc[at : at + GROUP]
                yield pd.DataFrame({"id": some["id"], "ids": [b"".join(coder.parts(x)) + end if x else end for x in some["text"]]})

    return documents.mapInPandas(run, "id long, ids binary").withColumn("wide", F.lit(wide))


def _save(rows: DataFrame, folder: str, mode: str) -> None:
    rows.sparkSession.dataSource.register(TokenRecords)
    rows.select("id", "ids", "wide").write.format("token_records").mode(mode).save(folder)


def write_records(rows: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Write rows (id, ids, wide) in ascending order of id as shards in folder, which all executors must reach.

    mode overwrite replaces what is there once the new manifest stands; append puts the new shards behind the old ones.
    """
    _save(placed(rows, "id"), folder, mode)


def write_documents(documents: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, mode: str = "overwrite") -> None:
    """write_records() of documents: their texts are put in order first, and encoded where they are written."""
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    _save(encoded(placed(texts, "id"), path, end_id), folder, mode)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (id, start, n_tokens, ids) of all records, lengths and checksums tested; ids are little-endian, of 4 bytes each, start the number of ids in records before."""
    spark.dataSource.register(TokenRecords)
    return spark.read.format("token_records").load(folder)


def read_shuffled(spark: SparkSession, folder: str, seed: int) -> DataFrame:
    """The rows of read_records() in an order that the seed fixes, dealt over partitions: the index is shuffled, and each record fetched where it lies."""
    spark.dataSource.register(TokenRecords)
    index = spark.read.format("token_records").option("index", "true").load(folder).withColumn("key", F.xxhash64(F.lit(seed), "shard", "record"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(folder)
        held: dict[str, object] = {}
        for batch in batches:
            for at in range(0, len(batch), GROUP):
                some = batch.iloc[at : at + GROUP]
                found = []
                for shard, offset, length in zip(some["shard"], some["offset"], some["length"], strict=True):
                    if shard not in held:
                        if len(held) >= 64:
                            held.pop(next(iter(held))).close()
                        held[shard] = store.open_input_file(f"{base}/{shard}.records")
                    found.append(held[shard].read_at(int(length), int(offset)))
                keys, starts, sizes, ids = _batch(found, some["start"].tolist())
                yield pd.DataFrame({"id": pd.array(keys, "Int64"), "start": starts, "n_tokens": sizes, "ids": ids})

    return index.repartitionByRange(n, "key").sortWithinPartitions("key", "shard", "record").mapInPandas(fetch, SCHEMA)


def round_trip(documents: DataFrame, path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Rows (id, start, n_tokens, ids_crc32) read back from the files that the documents are written to, one for each row of documents.

    Null and empty texts have end_id alone; repeated rows are written each time; an empty table gives no rows; ids are whole numbers or null; other
    columns are not read. folder is by default a new one in the shared folder.
    """
    spark = documents.sparkSession
    folder = folder or f"{shared_dir(spark)}/chatlake/records-{uuid.uuid4().hex}"
    write_documents(documents, path, folder, id_col, text_col, end_id)
    return read_records(spark, folder).select(F.col("id").alias(id_col), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
