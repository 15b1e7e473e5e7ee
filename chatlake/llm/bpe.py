"""Byte-level BPE encoding and decoding with a contiguous rank array per word.

A word starts as its bytes. One list holds the ids of its parts and another, of one element less, the rank of the merge of
each adjacent pair. The least rank is found by scanning, its boundary is deleted, and the ranks beside it are refreshed:
for short words this beats any heap. Words of over LONG_WORD bytes, where scanning would be quadratic, take a heap of the
same (rank, position) order, so results do not depend on length.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The pre-token pattern of byte-level BPE vocabularies of this kind. A fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WORD = 256
#: Entries that a worker's cache holds before it starts anew, and characters of the longest key that it keeps, so that its bytes are bounded too.
CACHE, LONGEST_KEY = 600_000, 100
NEVER = 1 << 60
#: A space next to other white space, where a text can't be taken apart at its spaces.
_ODD = re.compile(r" \s|[^\S ] ")


class Cache(dict):
    """Memo of a function of one string, emptied when it holds `limit` entries; strings of over LONGEST_KEY characters are not kept."""

    def __init__(self, fn: Callable[[str], object], limit: int = CACHE):
        self.fn, self.limit = fn, limit

    def __missing__(self, key: str):
        if len(key) > LONGEST_KEY:
            return self.fn(key)
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.fn(key)
        return value


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    """A byte-level BPE vocabulary read from a tokenizers .json file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        raw = {t: bytes(letters[c] for c in t) for t in vocab if all(c in letters for c in t)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: raw[t] for t, i in vocab.items() if t in raw} | {i: t.encode() for t, i in self.special.items()}
        self.first = [0] * 256
        for t, b in raw.items():
            if len(b) == 1:
                self.first[b[0]] = vocab[t]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.split = regex.compile(PATTERN).findall
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.size = max(self.bytes_of) + 1

    def word(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids, merges = [self.first[b] for b in data], self.merges
        if len(ids) > LONG_WORD:
            return self._long(ids)
        ranks = [merges.get(pair, (NEVER,))[0] for pair in zip(ids, ids[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            k = ranks.index(least)
            ids[k] = merges[ids[k], ids[k + 1]][1]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = merges.get((ids[k - 1], ids[k]), (NEVER,))[0]
            if k < len(ranks):
                ranks[k] = merges.get((ids[k], ids[k + 1]), (NEVER,))[0]
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        n, merges = len(ids), self.merges
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def push(i: int) -> None:
            if i >= 0 and after[i] < n and (m := merges.get((ids[i], ids[after[i]]))):
                heapq.heappush(heap, (m[0], i, ids[i], ids[after[i]]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if ids[i] != a or after[i] >= n or ids[after[i]] != b:
                continue
            gone = after[i]
            ids[i], ids[gone] = merges[a, b][1], -1
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            push(before[i])
            push(i)
        return [x for x in ids if x >= 0]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


class TextEncoder:
    """Encodes texts part by part through caches; what is cached of a part is packed(ids), and parts() lists those.

    Where no space stands next to other white space, each space begins a pre-token, so the text is taken apart at its
    spaces and the caches work on what lies between; other texts are split by the pattern. Special tokens' strings in a
    text are taken out first, as the library's default is.
    """

    def __init__(self, bpe: ByteBPE, packed: Callable[[list[int]], object], encode: Callable[[str], list[int]] | None = None):
        word = Cache(lambda w: bpe.word(w.encode("utf-8")))
        encode = encode or (lambda part: [i for w in bpe.split(part) for i in word[w]])
        self.plain, self.spaced = Cache(lambda x: packed(encode(x))), Cache(lambda x: packed(encode(" " + x)))
        self.bpe, self.special = bpe, {t: packed([i]) for t, i in bpe.special.items()}

    def parts(self, text: str) -> list:
        special = self.special
        if special and any(t in text for t in special):
            out = []
            for piece in self.bpe.special_split(text):
                out += [special[piece]] if piece in special else self._parts(piece)
            return out
        return self._parts(text)

    def _parts(self, text: str) -> list:
        if not text:
            return []
        if _ODD.search(text):
            return list(map(self.plain.__getitem__, self.bpe.split(text)))
        first, *rest = text.split(" ")
        out = list(map(self.spaced.__getitem__, rest))
        return [self.plain[first], *out] if first else out


@lru_cache(maxsize=4)
def _coder(path: str) -> tuple[TextEncoder, dict[str, bytes]]:
    bpe = load(path)
    return TextEncoder(bpe, lambda ids: ",".join(map(str, ids))), {str(i): b for i, b in bpe.bytes_of.items()}


def bpe_encode(text: Column, path: str) -> Column:
    """The ids of a text as an array<int>; empty for null and empty texts. The whole text is encoded."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        coder, _ = _coder(path)
        return pd.Series([[int(i) for i in ",".join(coder.parts(x)).split(",")] if x else [] for x in texts])

    return encode(text)


def bpe_decode(ids: Column, path: str) -> Column:
    """The text of an array of ids, special tokens included; '' for null and empty arrays, null ids are skipped. Unknown ids raise."""

    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        bpe = load(path)
        return pd.Series([bpe.decode(int(i) for i in x if i is not None and i == i) if x is not None else "" for x in rows])

    return decode(ids)


def bpe_digest(text: Column, path: str) -> Column:
    """A struct (n_tokens, ids_sha256, decoded_sha256) of a text: encoded as in bpe_encode, then decoded as in bpe_decode.

    The digests are of the decimal ids joined by commas, and of the decoded text in UTF-8. Made in one pass, so that ids of
    long texts need not pass between processes.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        coder, table = _coder(path)
        out = []
        for x in texts:
            ids = ",".join(coder.parts(x)) if x else ""
            each = ids.split(",") if ids else []
            text = b"".join(map(table.__getitem__, each)).decode("utf-8", "replace")
            out.append((len(each), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode("utf-8")).hexdigest()))
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest(text)


def bpe_round_trip(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256), one for each row of documents; null texts count as empty.

    Row by row: no shuffle, other columns are ignored, repeated rows stay, an empty table gives none.
    """
    return documents.select(F.col(id_col), bpe_digest(F.col(text_col), path).alias("_d")).select(id_col, "_d.*")
