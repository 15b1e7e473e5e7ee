"""Packing of documents into sequences along a space-filling curve.

Each document becomes token ids, closed by id 0, and a vector of hashed token counts, which a fixed random projection takes to
a few dimensions. The Hilbert key of that point orders the corpus: documents near on the curve are near in content. The
rows are sorted by range of (key, hash of id), which splits even a key that a third of all rows share, and each partition fills
sequences with the documents as they come. Where a partition ends, the rest is dealt to sequences of a power of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm import bpe
from chatlake.llm.common import bound_batches, cut

SEQUENCE, END_ID = 1024, 0
#: Buckets of the hashed vector, dimensions of the projection and bits of each on the curve.
BUCKETS, DIMENSIONS, BITS = 256, 4, 12


@lru_cache(maxsize=2)
def _encoder(path: str) -> tuple[bpe.TextEncoder, np.dtype]:
    """Ids packed as little-endian integers, of two bytes where the vocabulary allows."""
    vocabulary = bpe.load(path)
    kind = np.dtype("<u2" if vocabulary.size <= 1 << 16 else "<u4")
    ranks = {b: i for i, b in vocabulary.bytes_of.items() if i not in vocabulary.special.values()}
    fast = tiktoken.Encoding("packing", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.TextEncoder(vocabulary, lambda ids: np.array(ids, kind).tobytes(), fast.encode_ordinary), kind


@lru_cache(maxsize=2)
def _projection(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each id, and the random projection of bucket counts."""
    rng = np.random.default_rng(20_240_501)
    return rng.integers(0, BUCKETS, size), rng.standard_normal((BUCKETS, DIMENSIONS))


def project(ids: np.ndarray, size: int) -> np.ndarray:
    """The point of a document: its hashed, damped token counts, scaled to length 1 and projected; 0 for no ids."""
    bucket, plane = _projection(size)
    counts = np.log1p(np.bincount(bucket[ids], minlength=BUCKETS)) if len(ids) else np.zeros(BUCKETS)
    norm = np.linalg.norm(counts)
    return counts @ plane / norm if norm else np.zeros(DIMENSIONS)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The position of each row of non-negative integers below 2 ** bits on the Hilbert curve (Skilling, 2004)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_key(vectors: np.ndarray) -> np.ndarray:
    """Hilbert keys of projected vectors; a coordinate runs over -3 to 3."""
    cells = np.clip((vectors + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert_keys(cells)


def pieces(lengths: Iterator[tuple[int, int]], last: bool = True, size: int = SEQUENCE) -> Iterator[tuple[int, int, int, int, int]]:
    """Cut a run of documents (row, length) into (row, start, length, sequence, offset).

    Sequences hold `size` ids, and the rest at the end, fewer than `size`, is dealt to sequences of falling powers of two, so that
    none of them needs padding.
    """
    queue = list(lengths)
    total = sum(n for _, n in queue)
    room = [size] * (total // size) + [1 << b for b in range(size.bit_length() - 1, -1, -1) if total % size >> b & 1]
    sequence, at = 0, 0
    for row, n in queue:
        start = 0
        while start < n:
            take = min(n - start, room[sequence] - at)
            yield row, start, take, sequence, at
            start, at = start + take, at + take
            if at == room[sequence]:
                sequence, at = sequence + 1, 0


def pack(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Rows (id, start, length, ids_crc32, doc_tokens, sequence_id, offset [, ids]), one for each piece of a document.

    A document is the ids of its whole text (null: empty) without added special tokens, then id 0, so each row of documents has at
    least one piece; repeated rows are packed as often as they come. Sequences hold exactly `size` ids but for the last few of a
    partition, which hold powers of two. Other columns are not read; an empty table gives no rows. sequence_id is the partition's
    number times 2 ** 32 plus a running number.
    """
    bound_batches(documents.sparkSession)
    kind = dict(documents.dtypes)[id_col]
    item = _encoder(path)[1]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, kind = _encoder(path)
        end = np.array([END_ID], kind).tobytes()
        for batch in batches:
            for at in range(0, len(batch), 1000):
                some = batch.iloc[at : at + 1000]
                data = [b"".join(coder.parts(x)) + end if x else end for x in some["text"]]
                points = np.array([project(np.frombuffer(x, kind)[:-1], coder.bpe.size) for x in data])
                yield pd.DataFrame({"id": some["id"], "key": curve_key(points), "ids": data})

    coded = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(encode, f"id {kind}, key long, ids binary")
    # Sorting by range reads its input twice; written out, the texts are encoded once.
    coded = cut(coded).withColumn("tie", F.xxhash64(F.col("id").cast("string"), F.octet_length("ids")))
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, number, carried, held = TaskContext.get().partitionId() << 32, 0, [], 0

        def out(rows: list, final: bool) -> tuple[pd.DataFrame, list]:
            """Pieces of as many whole sequences as the rows fill, and what is left of the last row."""
            nonlocal number
            total = sum(len(x[1]) - x[2] for x in rows)
            made = []
            filled = total if final else total // size * size
            left, lengths = filled, []
            for k, (_, ids, start) in enumerate(rows):
                lengths.append((k, min(len(ids) - start, left)))
                left -= lengths[-1][1]
            top = number
            for k, start, length, sequence, offset in pieces(iter(lengths), size=size):
                i, ids, before = rows[k]
                part = ids[before + start : before + start + length]
                made.append((i, before + start, length, zlib.crc32(part.astype("<u4").tobytes()), len(ids), base + number + sequence, offset) + ((part.astype(np.int32),) if with_ids else ()))
                top = number + sequence + 1
            number = top
            rest = [(i, ids, start + n) for (i, ids, start), (_, n) in zip(rows, lengths, strict=True) if start + n < len(ids)]
            return pd.DataFrame(made, columns=columns), rest

        columns = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        for batch in batches:
            for i, data in zip(batch["id"], batch["ids"], strict=True):
                ids = np.frombuffer(data, item)
                carried.append((i, ids, 0))
                held += len(ids)
                if held >= 256 * size:
                    done, carried = out(carried, False)
                    held = sum(len(x[1]) - x[2] for x in carried)
                    yield done
        if carried:
            yield out(carried, True)[0]

    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return coded.repartitionByRange(n, "key", "tie").sortWithinPartitions("key", "tie", "id", "ids").mapInPandas(fill, schema)
