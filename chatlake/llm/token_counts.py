"""Token counts by a map-side lookup of two tiers; no pre-token is ever shuffled over the corpus.

In a SentencePiece vocabulary where no piece has a space mark after another character, tokens never cross the start of a
run of spaces. So a text's count is the sum over its pre-tokens, each a run of spaces with the characters that follow.
Tier one is a compact hash table from frequent pre-tokens to lengths, broadcast to all workers; tier two, for the rest, a
worker's own cache, filled by the library itself. The table only saves time: counts do not depend on what it holds.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Bounds of tier one and of the sample that fills it, entries of a worker's cache before it starts anew, and characters of the longest key that it keeps.
TABLE_ROWS, SAMPLE_ROWS, SAMPLE_CHARS, CACHE, LONGEST_KEY = 65_536, 2_000, 20_000, 600_000, 100
#: A pre-token without the space before it: what follows a single space, or the further spaces and what follows them.
_PRETOKEN = re.compile(r"(?:^| )( *[^ ]+)")


@lru_cache(maxsize=4)
def load(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def splits_at_spaces(path: str) -> bool:
    """Whether this vocabulary never crosses the start of a run of spaces, keeps all spaces and puts one before a text."""
    sp = load(path)
    inner = any(SPACE in sp.id_to_piece(i).lstrip(SPACE) for i in range(sp.get_piece_size()))
    return not inner and sp.encode("a  b ", out_type=str)[:1] == [SPACE + "a"] and sp.decode(sp.encode("a  b ")) == "a  b "


class Counts(dict):
    """Token counts of pre-tokens without their first space; misses are encoded and kept up to a bound."""

    def __init__(self, path: str, table: dict[str, int], limit: int = CACHE):
        super().__init__(table)
        self.encode, self.table, self.limit = load(path).encode, table, limit + len(table)
        self.whole = not splits_at_spaces(path)

    def __missing__(self, key: str) -> int:
        if len(key) > LONGEST_KEY:
            return len(self.encode(key))
        if len(self) >= self.limit:
            self.clear()
            self.update(self.table)
        n = self[key] = len(self.encode(key))
        return n

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        if self.whole:
            return len(self.encode(text))
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            body = text.rstrip(" ")
            if not body:
                return len(self.encode(text))
            tail = len(text) - len(body)
            after = len(self.encode("a" + " " * tail)) - len(self.encode("a")) if tail else 0
            return sum(map(self.__getitem__, _PRETOKEN.findall(body))) + after
        return sum(map(self.__getitem__, text.split(" ")))


_ready: dict[tuple, Counts] = {}


def frequent_pretokens(texts: DataFrame, text_col: str, rows: int = TABLE_ROWS, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> list[str]:
    """At most `rows` pre-tokens, the most frequent of a sample of sample_rows texts of up to sample_chars characters each.

    The sample is what Spark finds first, so filling the table neither scans the corpus again nor shuffles a pre-token.
    """
    found: Counter = Counter()
    for (text,) in texts.select(text_col).where(F.length(text_col).between(1, sample_chars)).limit(sample_rows).collect():
        found.update(text.split(" "))
    found.pop("", None)
    return [x for x, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:rows]]


def token_count(text: Column, path: str, table) -> Column:
    """Tokens of a whole text, 0 for null; table is a broadcast of (joined pre-tokens, their lengths as bytes, id)."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        joined, lengths, mark = table.value
        if (path, mark) not in _ready:
            _ready.clear()
            keys = joined.split(" ") if joined else []
            _ready[path, mark] = Counts(path, dict(zip(keys, lengths, strict=True)))
        of = _ready[path, mark].of
        return pd.Series([of(x) for x in texts], dtype="int64")

    return count(text)


def count_tokens(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", context: int = 4096) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit), one for each row of documents, of the whole texts.

    n_bytes is the length in UTF-8, n_tokens what the sentencepiece model at path makes of the text without begin or end
    tokens, over_limit whether that exceeds `context`. Null texts count as empty. Repeated rows stay; other columns, whatever
    their names, are not read; an empty table gives no rows. A vocabulary with spaces inside its pieces is counted text by text.
    """
    spark = documents.sparkSession
    keys = [] if not splits_at_spaces(path) else [k for k in frequent_pretokens(documents, text_col) if SPACE not in k]
    encoded = load(path).encode(keys) if keys else []
    rows = [(k, len(e)) for k, e in zip(keys, encoded, strict=True) if len(e) < 256]
    joined = " ".join(k for k, _ in rows)
    table = spark.sparkContext.broadcast((joined, bytes(n for _, n in rows), hash(joined)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return documents.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, path, table).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > context)
