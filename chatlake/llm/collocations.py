"""Phrase collocations of each language by Toivonen's mining: a sample proposes phrases, full passes count them and their border exactly.

The first pass counts a phrase if each part of it, down to its words, is a proposed one: the proposed phrases and the border around
them, which are the phrases that are not proposed though all their parts are. Most of the border is rare, so that pass adds up counts by
64-bit hashes of phrases, which are never too low. The second pass counts by their words the phrases whose hashes reached the least count.

A border phrase that reaches it, a failure, may have frequent extensions that were not counted. Any frequent phrase that is still missing holds
a failure: of its parts that are not proposed a shortest one was counted, and is as frequent. So the second pass also counts the
phrases that hold a failure and whose other parts are proposed, which closes the set: every frequent phrase is found with its exact count
whatever the sample was. Proposals, failures and reached hashes are kept in bit sets of a fixed size, which all tasks get; two phrases that
share bits only let more phrases be counted.

A task numbers the words of some megabytes of text, extends all phrases by a word at a time with array operations, and sends each distinct phrase
of those texts once, with its count, to the sum over the corpus.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.common import LARGE, bound_batches, cut, mix64

MAX_WORDS, MIN_COUNT, TOP, SUBSUMED = 5, 100, 2000, 100
#: Share of the documents that proposes phrases, and how far below its part of the least count the sample's threshold lies.
SAMPLE, LOWERED = 1 / 16, 0.5
#: Bits of each set of hashes: 8 MB. Two bits stand for a phrase; a fuller set lets more phrases be counted.
FILTER_BITS = 1 << 26
#: Phrases that a task holds before it sends them.
HELD = 400_000
#: Parts of the input that a task of the second pass takes, unless that leaves fewer than two tasks for each core: each task gives each frequent phrase once.
TAKEN = 4
#: Words of 64 bits that one task puts together.
BLOCK = 4096
#: Bytes of text that a task counts at a time, and of a text that it takes at a time, up to the end of a piece.
CHUNK, SEGMENT = 4 << 20, 2 << 20
#: All that ends a piece becomes a full stop, and tabs become spaces.
_FOLD = bytes(ord(".") if c in b".,;:!?\n\v\f\r" else ord(" ") if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def segments(text: str) -> Iterator[bytes]:
    """A text, folded, in parts of about SEGMENT bytes that end where a piece ends."""
    data = text.encode("utf-8").translate(_FOLD)
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= SEGMENT else data.find(b".", at + SEGMENT) + 1 or len(data)
        yield data[at:end]
        at = end


def numbered(parts: dict[str, list[bytes]]) -> tuple[np.ndarray, list[tuple[str, bytes]]]:
    """(numbers, words) of folded texts by language: words are numbered from 1 on, a language's apart from the others', and 0 ends a piece."""
    ids, words = [], []
    for lang, texts in parts.items():
        blob = b".".join(texts).replace(b".", b" . ")
        coded = pc.split_pattern(pa.array([blob], pa.large_binary()), " ").flatten().dictionary_encode()
        new = coded.dictionary.to_pylist()
        number = np.array([-1 if w == b"" else 0 if w == b"." else 1 for w in new], np.int32)
        real = number > 0
        number[real] = np.arange(len(words) + 1, len(words) + 1 + real.sum())
        words += [(lang, w) for w, is_word in zip(new, real.tolist(), strict=True) if is_word]
        own = number[coded.indices.to_numpy()]
        ids += [own[own >= 0], np.zeros(1, np.int32)]
    return np.concatenate(ids), words


def word_hashes(words: list[tuple[str, bytes]]) -> np.ndarray:
    seeds = {lang: xxhash.xxh64_intdigest(lang) for lang in {x for x, _ in words}}
    return np.fromiter((xxhash.xxh64_intdigest(w, seeds[lang]) for lang, w in words), np.uint64, len(words))


def extended(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one word more."""
    return mix64(phrase * np.uint64(0x9E3779B97F4A7C15) + word)


def proposed(bits: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have both of their bits set; all if there is no set."""
    if bits is None:
        return np.ones(len(hashes), bool)
    out = np.ones(len(hashes), bool)
    for shift in (0, 32):
        place = (hashes >> np.uint64(shift)) & np.uint64(len(bits) * 64 - 1)
        out &= (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0
    return out


def count_chunk(ids: np.ndarray, words: list[tuple[str, bytes]], bits: np.ndarray | None, max_words: int, failures: np.ndarray | None = None, reached: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
    """(length, hashes, counts, parts) of the distinct phrases of numbered words (0 ends a piece) that a pass counts, by length; a count of 0 stands for one that it does not.

    Without failures, the first pass: what the proposals let count. With failures, the second: of those what reached the least count, and what failures add. parts has,
    for each length so far, the first phrase's number and last word of each phrase.
    """
    hash_of = np.concatenate([[np.uint64(0)], word_hashes(words)]).astype(np.uint64)
    at = np.flatnonzero(ids)  # where phrases of the present length begin
    number, kinds = pd.factorize(ids[at])  # their numbers, and what stands for each
    hashes, parts = hash_of[kinds], [(None, kinds)]
    first_pass, failed = np.ones(len(kinds), bool), np.zeros(len(kinds), bool)  # counted by the first pass; holds a failure
    for length in range(1, max_words + 1):
        counts = np.bincount(number, minlength=len(hashes))
        yield length, hashes, counts if failures is None else np.where(first_pass & ~proposed(reached, hashes), 0, counts), parts
        if length == max_words or not len(at):
            return
        named = proposed(bits, hashes)
        if failures is not None:
            failed = failed | first_pass & proposed(failures, hashes)
        on = named | failed
        places = np.flatnonzero(on[number[:-1]] & on[number[1:]] & (at[1:] == at[:-1] + 1))
        if not len(places):
            return
        code = number[places].astype(np.int64) * (len(words) + 1) + ids[at[places] + length]  # the phrase, and the word after it
        longer, distinct = pd.factorize(code)
        some = np.zeros(len(distinct), np.int64)
        some[longer] = places  # one place of each distinct phrase
        prefix, suffix, word = number[some], number[some + 1], distinct % (len(words) + 1)
        first_pass = first_pass[prefix] & named[prefix] & first_pass[suffix] & named[suffix]
        failed = failed[prefix] | failed[suffix]
        hashes = extended(hashes[prefix], hash_of[word])
        parts = [*parts, (prefix, word)]
        at, number = at[places], longer


def spelled(parts: list, words: list[tuple[str, bytes]], chosen: np.ndarray) -> tuple[list[str], list[str]]:
    """(languages, phrases) of the chosen numbers of the longest phrases in parts."""
    columns, now = [], chosen
    for prefix, word in reversed(parts):
        columns.append(word[now])
        now = now if prefix is None else prefix[now]
    columns.reverse()
    one = [[words[w - 1][1] for w in c.tolist()] for c in columns]
    langs = [words[w - 1][0] for w in columns[0].tolist()]
    return langs, [b" ".join(x).decode("utf-8") for x in zip(*one, strict=True)] if len(one) > 1 else [x.decode("utf-8") for x in one[0]]


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, list[tuple[str, bytes]]]]:
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            for some in segments(text):
                held.setdefault(lang, []).append(some)
                size += len(some)
                if size >= CHUNK:
                    yield numbered(held)
                    held, size = {}, 0
    if size:
        yield numbered(held)


def hash_counts(texts: DataFrame, bits, max_words: int) -> DataFrame:
    """Rows (hash, n) of the phrases of texts (lang, text) that the proposals, a broadcast, let count; without them, of all phrases."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, words in _chunks(batches):
            for _, hashes, counts, _ in count_chunk(ids, words, bits and bits.value, max_words):
                for at in range(0, len(hashes), 100_000):
                    yield pd.DataFrame({"hash": hashes[at : at + 100_000].view(np.int64), "n": counts[at : at + 100_000]})

    return texts.mapInPandas(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def phrase_counts(texts: DataFrame, bits, failures, reached, max_words: int) -> DataFrame:
    """Rows (lang, phrase, n) of what the second pass counts, and the number of words of each language as the phrase ''. The bit sets are broadcasts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = defaultdict(Counter)  # of the task, so that a phrase leaves it once

        def rows() -> Iterator[pd.DataFrame]:
            for lang, counts in held.items():
                phrases, n = list(counts), list(counts.values())
                for at in range(0, len(n), 50_000):
                    yield pd.DataFrame({"lang": lang, "phrase": phrases[at : at + 50_000], "n": n[at : at + 50_000]})
            held.clear()

        for ids, words in _chunks(batches):
            langs, n = np.unique([x for x, _ in words], return_inverse=True)
            for lang, total in zip(langs.tolist(), np.bincount(n, np.bincount(ids, minlength=len(words) + 1)[1:]).astype(np.int64).tolist(), strict=True):
                held[lang][""] += total
            for _, _, counts, parts in count_chunk(ids, words, bits.value, max_words, failures.value, reached.value):
                chosen = np.flatnonzero(counts)
                for lang, phrase, total in zip(*spelled(parts, words, chosen), counts[chosen].tolist(), strict=True):
                    held[lang][phrase] += total
            if sum(map(len, held.values())) > HELD:
                yield from rows()
        yield from rows()

    return texts.mapInPandas(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def unproposed(hashes: DataFrame, bits) -> DataFrame:
    """The rows (hash) that the bit set, a broadcast, lacks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[~proposed(bits.value, batch["hash"].to_numpy(np.int64).view(np.uint64))]

    return hashes.select("hash").mapInPandas(run, "hash long")


def with_bits(bits: np.ndarray, hashes: DataFrame) -> np.ndarray:
    """The bit set with two bits set for each hash. The driver gets the blocks of BLOCK words that have any, as many as the set has at most."""
    size = len(bits) * 64
    place = F.explode(F.array(F.col("hash").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(size - 1))))
    words = hashes.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 AS int)))").alias("bits"))

    def joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros(BLOCK, np.int64)
        block[rows["word"].to_numpy() % BLOCK] = rows["bits"].to_numpy()
        return pd.DataFrame({"block": [key[0]], "data": [block.tobytes()]})

    out = bits.copy()
    for block, data in words.withColumn("block", F.floor(F.col("word") / BLOCK)).groupBy("block").applyInPandas(joined, "block long, data binary").toLocalIterator():
        at = block * BLOCK
        out[at : at + BLOCK] |= np.frombuffer(data, np.uint64)[: len(out) - at]
    return out


def frequent_phrases(texts: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, sample: float = SAMPLE, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Rows (lang, phrase, n): all phrases of up to max_words words that come at least min_count times in the texts (lang, text) of a language, and its number of words as the phrase ''."""
    sc = texts.sparkSession.sparkContext
    none = np.zeros(filter_bits // 64, np.uint64)
    rows = hash_counts(texts.sample(sample, 1), None, max_words)
    bits = sc.broadcast(with_bits(none, rows.where(F.col("n") >= max(2, int(LOWERED * sample * min_count)))))
    reached = cut(hash_counts(texts, bits, max_words).where(F.col("n") >= min_count).select("hash"))
    failures = sc.broadcast(with_bits(none, unproposed(reached, bits)))
    # Without a shuffle; more parts and more frequent phrases would else multiply.
    shared = texts.coalesce(max(2 * sc.defaultParallelism, texts.rdd.getNumPartitions() // TAKEN))
    counted = phrase_counts(shared, bits, failures, sc.broadcast(with_bits(none, reached)), max_words)
    return cut(counted.where((F.col("n") >= min_count) | (F.col("phrase") == "")))


def _joined(words: Column, start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(
    documents: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, subsumed: int = SUBSUMED, sample: float = SAMPLE, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the best `top` phrases of 2 to max_words words of each language.

    a is the count of the phrase, l and r those of its parts at the cut that scores least, n the words of the language, and score
    floor(1000 a n / (l r)), in decimals of 38 digits. A phrase inside a longer one that comes at least subsumed percent as often is left out. Ties go by a, then
    by the phrase's bytes. A null language is 'und'; null, empty and wordless texts count nothing; repeated rows count each time; an empty table, or
    one without a frequent phrase, gives no rows; other columns are not read. A task holds CHUNK bytes of text and the longest piece.
    """
    bound_batches(documents.sparkSession)
    texts = documents.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text <> ''")
    found = frequent_phrases(texts, min_count, max_words, sample, filter_bits)
    total = found.where("phrase = ''").select("lang", F.col("n").alias("_total"))
    phrases = found.where("phrase <> ''").withColumnRenamed("n", "a")
    longer = phrases.withColumn("w", F.split("phrase", " ")).withColumn("k", F.size("w")).where("k > 1")
    cuts = longer.select("lang", "phrase", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    parts = cuts.select("lang", "phrase", "a", "cut", _joined(F.col("w"), 1, F.col("cut")).alias("_l"), _joined(F.col("w"), F.col("cut") + 1, F.col("k")).alias("_r"))
    for side in ("l", "r"):
        parts = parts.join(phrases.select("lang", F.col("phrase").alias(f"_{side}"), F.col("a").alias(side)).hint("merge"), ["lang", f"_{side}"])
    few = total.limit(LARGE + 1).count() <= LARGE
    sized = parts.join(F.broadcast(total) if few else total.hint("merge"), "lang")
    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "_total", "l", "r")}
    scored = sized.withColumn("_x", 1000 * exact["a"] * exact["_total"]).withColumn("_y", exact["l"] * exact["r"]).withColumn("score", F.expr("_x div _y"))
    least = scored.groupBy("lang", "phrase", "a", F.col("_total").alias("n")).agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    # Each candidate's parts of two words or more, with the count of the longest-lived phrase around them.
    starts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    inside = longer.where("k > 2").select("lang", F.explode(starts).alias("phrase"), F.col("a").alias("_f")).groupBy("lang", "phrase").agg(F.max("_f").alias("_f"))
    kept = least.join(inside.hint("merge"), ["lang", "phrase"], "left").where(F.col("_f").isNull() | (100 * F.col("_f") < subsumed * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.col("m.score").desc(), F.col("a").desc(), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "m.l", "m.r", "n", "m.score")
