"""Importance resampling towards a target: hashed n-gram features of raw and target texts, and a draw without replacement.

A text's ASCII letters are lowered and each run of separators becomes one space; a regular expression, scanned with overlapping
matches between the boundaries of words, gives the spans of all n-grams that begin at a word, and a running CRC-32 over a span's words
gives the bucket of each. A text is scanned once: its buckets are written out, two bytes for each feature, and both the counts over all
texts and the weights are taken from those. Counts are sums of one fixed-size array for each task. The draw adds a Gumbel variate, fixed by
the document's id, to each weight, and ranks by a range sort whose partitions are numbered from their sizes.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import bound_batches, cut

BUCKETS, MAX_WORDS, MIN_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
#: Words are runs of digits, lower-case letters and all that is not ASCII; the rest becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_SPACES = regex.compile(rb"  +")


def spans(max_words: int) -> regex.Pattern:
    """Matches, when overlaps are asked for, a word and those after it, up to max_words: the first in group 1, each other with the space before it in a group of its own."""
    return regex.compile(b" ([^ ]++)" + b"( [^ ]++)?+" * (max_words - 1) + b"(?= )")


def buckets_of(text: str | None, pattern: regex.Pattern, buckets: int) -> tuple[int, np.ndarray]:
    """(words, the bucket of each feature) of a text; features are its runs of words, joined by single spaces."""
    flat = _SPACES.sub(b" ", b" " + (text or "").encode("utf-8").translate(_FOLD) + b" ")
    found, crc32, words = array("I"), zlib.crc32, 0
    for match in pattern.finditer(flat, overlapped=True):
        crc = 0
        for part in match.groups():
            if part is None:
                break
            crc = crc32(part, crc)
            found.append(crc)
        words += 1
    return words, (np.frombuffer(found, np.uint32) % buckets).astype("<u2" if buckets <= 1 << 16 else "<u4")


def features(texts: DataFrame, text_col: str, keep: list[Column], buckets: int = BUCKETS, max_words: int = MAX_WORDS) -> DataFrame:
    """Rows (keep.., n_words, n_features, buckets), one for each row of texts; buckets is the packed bucket of each feature. Null texts have none."""
    bound_batches(texts.sparkSession)
    chosen = texts.select(*keep, F.col(text_col).alias("text"))
    kept = chosen.columns[:-1]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pattern = spans(max_words)
        for batch in batches:
            for at in range(0, len(batch), 250):
                some = batch.iloc[at : at + 250]
                made = [buckets_of(x, pattern, buckets) for x in some["text"]]
                yield some[kept].assign(n_words=[n for n, _ in made], n_features=[len(b) for _, b in made], buckets=[b.tobytes() for _, b in made])

    kinds = "".join(f"`{c}` {t}, " for c, t in chosen.dtypes[:-1])
    return chosen.mapInPandas(scan, f"{kinds}n_words long, n_features long, buckets binary")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall into each bucket. A task gives one row for each bucket, and the driver as many sums."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch["buckets"]:
                total += np.bincount(np.frombuffer(data, kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some, "n": total[some]})

    rows = found.select("buckets").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(buckets, np.int64)
    for bucket, n in rows:
        total[bucket] = n
    return total


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket floor(1000 ln((t + 1) (S + B) / ((s + 1) (T + B)))): how much likelier it is in the target, with one more of each."""
    size, s_all, t_all = len(raw), float(raw.sum() + len(raw)), float(target.sum() + len(raw))
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64).reshape(size)


def weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """found with weight, the floored mean of its features' gains (0 without features), instead of its buckets. gain, one number a bucket, is broadcast."""
    held = found.sparkSession.sparkContext.broadcast(gain)
    kind = np.dtype("<u2" if len(gain) <= 1 << 16 else "<u4")

    @F.pandas_udf("long")
    def weight(rows: pd.Series) -> pd.Series:
        table = held.value
        return pd.Series([int(table[np.frombuffer(x, kind)].sum()) // (len(x) // kind.itemsize) if x else 0 for x in rows], dtype="int64")

    return found.withColumn("weight", weight("buckets")).drop("buckets")


def gumbel(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u in (0, 1) from the first 8 hex digits of the SHA-256 of `seed:key`; a null key counts as ''."""
    u = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(u)))


def ranked(rows: DataFrame, drawable: Column, order: list[Column], percent: int) -> DataFrame:
    """rows with rank: 1, 2, 3.. in `order` for the first floor(percent * N / 100) of the N drawable ones, else null.

    Sorted by range; each partition numbers its rows, and the sizes of the partitions before it, as many as there are partitions, are added.
    order must tell any two rows apart, so that no partition has to take many.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    flagged = rows.withColumn("_in", F.coalesce(drawable, F.lit(False)))
    keys = [F.col("_in").desc(), *order]

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield batch.assign(_part=part, _at=np.arange(seen + 1, seen + len(batch) + 1))
            seen += len(batch)

    kinds = ", ".join(f"`{c}` {t}" for c, t in flagged.dtypes)
    placed = cut(flagged.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInPandas(number, f"{kinds}, _part int, _at long"))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.count_if("_in").alias("n_in")).orderBy("_part").collect()  # a row for each partition
    before, total = [], 0
    for part, size, _ in sizes:
        before.append((part, total))
        total += size
    drawn = percent * sum(r.n_in for r in sizes) // 100
    offsets = spark.createDataFrame(before, "_part int, _before long")
    rank = F.col("_before") + F.col("_at")
    return placed.join(F.broadcast(offsets), "_part").withColumn("rank", F.when(F.col("_in") & (rank <= drawn), rank)).drop("_part", "_at", "_in", "_before")


def resample(
    documents: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, max_words: int = MAX_WORDS, seed: int = SEED
) -> DataFrame:
    """Rows (id, n_words, n_features, weight, score, rank), one for each row of documents; rank is null for those that are not drawn.

    Drawn are floor(percent * N / 100) of the N documents of at least min_words words, by the highest score; ties go to the smaller
    id, then to the row that Spark reads first. Documents without features (null, empty and separators alone) weigh 0 and are never drawn if
    min_words is over 0. A null id has the variate of ''. Repeated rows each count and may each be drawn; empty tables give no rows, an empty target a weight of
    all from the corpus alone; other columns are not read, whatever their names. max_words is the longest feature, in words.
    """
    found = cut(features(documents, text_col, [F.col(id_col).alias("id")], buckets, max_words).withColumn("row", F.monotonically_increasing_id()))
    wanted = features(target, target_text, [], buckets, max_words)
    scored = weighted(found, gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets)))
    scored = cut(scored.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)))  # the sort by range reads its input twice
    out = ranked(scored, F.col("n_words") >= min_words, [F.col("score").desc(), F.col("id").asc(), F.col("row").asc()], percent)
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")
