"""Language identification by words first: known words score by their log frequency in each language, unseen words fall
back to progressively shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import bound_batches

UNKNOWN = "und"
#: Labelled rows that a model is fitted on, of all languages together.
MAX_ROWS = 20_000
LONGEST = 4
#: Bytes of scores of unseen words that a worker keeps.
CACHE_BYTES = 32 << 20
_WORD = re.compile(r"[^\W\d_]+")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str) -> Iterator[tuple[int, int, str]]:
    """(position, length, n-gram) of a word between marks, lengths 1 to LONGEST."""
    marked = f"^{word}$"
    for at in range(len(marked)):
        for n in range(1, min(LONGEST, len(marked) - at) + 1):
            yield at, n, marked[at : at + n]


@dataclass(frozen=True)
class LanguageModel:
    """Log frequencies by language: the rows of words and of n-grams in their tables. `languages` are the labels learned, sorted."""

    languages: list[str]
    words: dict[str, int]
    word_rows: np.ndarray
    grams: dict[str, int]
    gram_rows: np.ndarray

    def unseen(self, word: str) -> np.ndarray:
        """Scores of a word that is not known: at each position the longest known n-gram that starts there."""
        marked, known, found = f"^{word}$", self.grams, []
        for at in range(len(marked)):
            for n in range(min(LONGEST, len(marked) - at), 0, -1):
                row = known.get(marked[at : at + n])
                if row is not None:
                    found.append(row)
                    break
        return self.gram_rows[found].sum(0, dtype=np.float64) / 3


def fit(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id", max_rows: int = MAX_ROWS) -> LanguageModel:
    """Learn from rows with text and a label: all of them, or about max_rows of them chosen by a hash of order_col, an equal number of each language
    as far as it has them, so that no language crowds out another.

    A word is known if it occurs twice or more in a language's rows; all n-grams are. Nothing else is left out, so the bound on rows is
    what bounds the model on the driver. No usable rows give a model without languages, which calls everything unknown.
    """
    bound_batches(documents.sparkSession)
    usable = documents.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(order_col).alias("_o")).where("text is not null and lang is not null")
    rows_of = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # one row for each label
    if sum(rows_of.values()) > max_rows:
        left, shares = max_rows, {}
        for k, (lang, n) in enumerate(sorted(rows_of.items(), key=lambda x: (x[1], x[0]))):
            shares[lang] = min(n, left // (len(rows_of) - k))
            left -= shares[lang]
        bound = F.create_map(*[F.lit(x) for lang, n in rows_of.items() for x in (lang, math.ceil(shares[lang] / n * (1 << 24)))])
        usable = usable.where(F.pmod(F.xxhash64("_o", F.lit(5)), F.lit(1 << 24)) < bound[F.col("lang")])

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                found.setdefault(lang, Counter()).update(_words(text))
        for lang, words in found.items():
            pieces: Counter = Counter()
            for w, c in words.items():
                for _, _, g in grams(w):
                    pieces[g] += c
            for kind, counts in (("w", words), ("g", pieces)):
                if counts:
                    keys = list(counts)
                    yield pd.DataFrame({"lang": lang, "kind": kind, "key": keys, "n": [counts[k] for k in keys]})

    counts = usable.select("lang", "text").mapInPandas(tally, "lang string, kind string, key string, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).where("n > 1 or kind = 'g'")
    kept: dict[str, dict[str, dict[str, int]]] = {"w": {}, "g": {}}
    for lang, kind, key, n in counts.toLocalIterator():
        kept[kind].setdefault(lang, {})[key] = n
    languages = sorted(set(kept["w"]) | set(kept["g"]))

    def table(by_lang: dict[str, dict[str, int]]) -> tuple[dict[str, int], np.ndarray]:
        keys = {k: i for i, k in enumerate(sorted({k for c in by_lang.values() for k in c}))}
        lots = np.full((len(keys), len(languages)), 0.5)
        for at, lang in enumerate(languages):
            mine = by_lang.get(lang, {})
            lots[[keys[k] for k in mine], at] += list(mine.values())
        logs = np.log(lots / np.maximum(lots.sum(0), 1e-9))
        return keys, (logs - logs.mean(1, keepdims=True) if len(languages) else logs).astype(np.float32)

    return LanguageModel(languages, *table(kept["w"]), *table(kept["g"]))


class Scorer:
    """Scores of texts by a model; the row of an unseen word is worked out once and kept, up to CACHE_BYTES in all."""

    def __init__(self, model: LanguageModel, limit: int = CACHE_BYTES):
        self.model, self.known, n = model, len(model.words), max(1, len(model.languages))
        self.most = max(1000, limit // (4 * n + 100))
        self.rows = np.zeros((self.most, len(model.languages)), np.float32)
        self.index = _Index(self)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of the posterior, of equal ones the first by name; (UNKNOWN, 0) for null, a text without letters, or a model without languages."""
        found = _words(text) if text else []
        if not found or not self.model.languages or not any(x.isalpha() for x in found):
            return UNKNOWN, 0.0
        total, known, step = np.zeros(len(self.model.languages)), self.model.words, min(self.most, 100_000)
        for at in range(0, len(found), step):  # so long a text can't outgrow the rows
            some = found[at : at + step]
            seen = [k for w in some if (k := known.get(w)) is not None]
            total += self.model.word_rows[seen].sum(0, dtype=np.float64)
            if len(seen) < len(some):
                others = [w for w in some if w not in known]
                if len(self.index) + len(others) > self.most:
                    self.index = _Index(self)
                total += self.rows[[self.index[w] for w in others]].sum(0, dtype=np.float64)
        best = int(total.argmax())
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


class _Index(dict):
    def __init__(self, scorer: Scorer):
        self.scorer = scorer

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        self.scorer.rows[k] = self.scorer.model.unseen(word)
        return k


_ready: dict[int, Scorer] = {}


def language_of(text: Column, model: Broadcast) -> Column:
    """A struct (lang_pred, score) for a column of whole texts; model is a broadcast LanguageModel, whose size fit() bounds."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        learned = model.value
        if id(learned) not in _ready:
            _ready.clear()
            _ready[id(learned)] = Scorer(learned)
        of = _ready[id(learned)].predict
        return pd.DataFrame([of(x) for x in texts], columns=["lang_pred", "score"])

    # Else a filter on the struct would be moved below it, with a copy of the function for each field.
    return predict.asNondeterministic()(text)


def held_out(id_col: Column) -> Column:
    """Rows that a model may not learn from: crc32 of the id as text is divisible by 5. Null ids are not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (id, held_out, lang_pred, score), one for each row of documents.

    The model learns from the rows that are not held out, and predicts from the text alone. Null texts and texts without a letter give
    UNKNOWN with score 0. Repeated rows stay; other columns are not read; an empty table gives no rows.
    """
    model = fit(documents.where(~held_out(F.col(id_col))), text_col, lang_col, id_col)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return documents.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), language_of(F.col(text_col), shared).alias("_p")).select(id_col, "held_out", "_p.*")


def keep_identified(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """The rows of documents whose text has a language with a score of at least `least`, lang set to what was found."""
    model = fit(documents.where(~held_out(F.col(id_col))), text_col, lang_col, id_col)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    judged = documents.withColumn("__language", language_of(F.col(text_col), shared))
    kept = judged.where((F.col("__language.lang_pred") != UNKNOWN) & (F.col("__language.score") >= least))
    return kept.withColumn(lang_col, F.col("__language.lang_pred")).drop("__language")
