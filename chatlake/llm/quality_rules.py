"""Quality by lines first: rules on punctuation, navigation and boilerplate judge each line, failing lines are removed, and a
document that loses too much of its text, or fails the base rules, is rejected."""

from __future__ import annotations

import re
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import bound_batches, words

SYMBOLS = "#*$%&|<>"
#: Words of a line that only separate entries of a menu.
SEPARATORS = frozenset(["|", ">", "<", "»", "«", "·", "•", "/", "::", "–", "—", "→"])
#: Beginnings of what pages say to readers rather than about a subject.
BOILERPLATE = (
    "privacy policy", "terms of use", "terms of service", "all rights reserved", "cookie policy", "we use cookies", "accept cookies", "enable javascript", "javascript is",
    "sign in", "sign up", "log in", "click here", "read more", "subscribe to our", "skip to content", "share this", "lorem ipsum",
)
#: A line fails with this many symbols or separators for each word, or this share of capitals among its letters.
SYMBOL_RATE, SEPARATOR_RATE, CAPITAL_SHARE, CAPITAL_LETTERS = 0.5, 0.3, 0.6, 8
#: A line of at least STUTTER_WORDS words fails if this share of them repeats the word before.
STUTTER_SHARE, STUTTER_WORDS = 0.5, 8
#: Phrases count in lines of fewer words than this.
SHORT_LINE = 25
#: Navigation by shape: a run of at least MENU_LINES lines with words, each of at most MENU_WORDS of them and without punctuation at its end.
MENU_LINES, MENU_WORDS = 4, 4
#: What a sentence, a heading with a colon, or a quotation ends with.
ENDS = ".!?:;,…。！？\"'”’»)]"
#: A document is rejected if less than this share of its words is left.
KEPT_SHARE = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
_UPPER, _LOWER = re.compile("[A-ZÀ-ÖØ-Þ]"), re.compile("[a-zß-öø-ÿ]")


def repeat_words(found: list[str], window: int = WINDOW) -> int:
    """How many words lie in a window of `window` words that occurs twice or more."""
    n = len(found) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, found), np.int64, len(found)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + (codes[k : k + n] ^ (codes[k : k + n] >> np.uint64(29)))
    order = np.argsort(mixed, kind="stable")
    ranked = mixed[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edges = np.zeros(len(found) + 1, np.int64)
    starts = np.flatnonzero(twice)
    edges[starts] += 1
    np.subtract.at(edges, starts + window, 1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def line_fails(line: str, mine: list[str]) -> bool:
    """Whether a line of these words breaks a rule: symbols for punctuation, shouting, stock phrases, stuttering, or a menu's separators; what a single line can't show is left to judge()."""
    n_words = len(mine)
    if sum(map(line.count, SYMBOLS)) >= SYMBOL_RATE * n_words:
        return True
    upper = len(_UPPER.findall(line))
    if upper >= CAPITAL_LETTERS and upper >= CAPITAL_SHARE * (upper + len(_LOWER.findall(line))):
        return True
    if n_words < SHORT_LINE:
        low = line.lower()
        if any(x in low for x in BOILERPLATE):
            return True
    if n_words >= STUTTER_WORDS and sum(map(eq, mine, mine[1:])) >= STUTTER_SHARE * n_words:
        return True
    return not SEPARATORS.isdisjoint(mine) and sum(w in SEPARATORS for w in mine) >= SEPARATOR_RATE * n_words


def menu_lines(shapes: list[tuple[int, bool]]) -> list[bool]:
    """For each line with words, given as (words, whether it ends with punctuation), whether it lies in a run that has the shape of a menu."""
    out, start = [False] * len(shapes), 0
    for k in range(len(shapes) + 1):
        if k < len(shapes) and shapes[k][0] <= MENU_WORDS and not shapes[k][1]:
            continue
        if k - start >= MENU_LINES:
            out[start:k] = [True] * (k - start)
        start = k + 1
    return out


def judge(text: str | None) -> tuple[int, int, int, int, int, bool, bool, int, str]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept_words, cleaned text) of a text.

    Lines end at \\n. A line equal to an earlier one fails as well, and so do the lines of a menu; lines without a word have no say and stay.
    """
    text = text or ""
    found = words(text)
    n = len(found)
    seen: set[str] = set()
    dup = left = 0
    lines = []
    split = [(line, words(line)) for line in text.split("\n")]
    menu = iter(menu_lines([(len(mine), mine[-1][-1] in ENDS) for _, mine in split if mine]))
    for line, mine in split:
        if not mine:
            lines.append(line)
            continue
        repeated = line in seen
        dup += repeated
        seen.add(line)
        if not next(menu) and not repeated and not line_fails(line, mine):
            left += len(mine)
            lines.append(line)
    repeats = repeat_words(found)
    base = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    kept = not base and left >= KEPT_SHARE * n
    return n, sum(map(len, found)), sum(map(text.count, SYMBOLS)), dup, repeats, base, kept, left, "\n".join(lines)


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words", "clean_text"]
_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, kept_words long"


def quality(text: Column, with_text: bool = False) -> Column:
    """judge() of a column of whole texts as a struct; clean_text only if with_text."""
    columns = FIELDS[: 9 if with_text else 8]

    @F.pandas_udf(_SCHEMA + ", clean_text string" * with_text)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(x)[: len(columns)] for x in texts], columns=columns)

    # Else a filter on the struct would be moved below it, with a copy of the function for each field.
    return run.asNondeterministic()(text)


def quality_report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Rows (id, the fields of judge()), one for each row of documents, clean_text only if with_text.

    Null and empty texts have no words, so they fail the base rules. Repeated rows stay; other columns are not read; an empty table
    gives no rows.
    """
    bound_batches(documents.sparkSession)
    return documents.select(F.col(id_col), quality(F.col(text_col), with_text).alias("_q")).select(id_col, "_q.*")


def clean_documents(documents: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows of documents that are kept, with the cleaned text, and chars_col, where there is one, set to its length."""
    bound_batches(documents.sparkSession)
    kept = documents.withColumn("__quality", quality(F.col(text_col), with_text=True)).where("__quality.kept").withColumn(text_col, F.col("__quality.clean_text")).drop("__quality")
    return kept.withColumn(chars_col, F.length(text_col).cast(dict(documents.dtypes)[chars_col])) if chars_col in documents.columns else kept
