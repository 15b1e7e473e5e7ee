"""Column functions over text: tokens, slugs, file names, highlighting, citations and links. [TXT, SEA-1/2/7/8/9, INS-10]"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}\p{Co}]+"
PHRASE = r"""[^\s"']+"""
#: Fixed value: what a citation is.
CITATION = r"\[([A-Za-z0-9][A-Za-z0-9._:-]*)#m?(\d+)\]"


def _folded_letters() -> tuple[str, str]:
    """Lower-case letters with one accent, and the plain letters that the index keeps for them."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        if letter == letter.lower() and len(parts) == 2 and parts[0].isascii() and unicodedata.combining(parts[1]):
            pairs[letter] = parts[0]
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _folded_letters()


def fold(text: Column) -> Column:
    """Lower case without accents, as terms are kept in the index."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    """The terms of a text in order: runs of letters and digits, folded; [] for null. No stemming, no splitting of CJK. [SEA-2]"""
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit(f"({TOKEN})"), 1), F.array().cast("array<string>"))


def spaced_tokens(text: Column) -> Column:
    """The tokens of a text before accents are taken off, one space apart; '' for null. Accents change no token's bounds."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(text), f"[^{TOKEN[1:-2]}]++", " ")), F.lit(""))


def phrases(query: Column) -> Column:
    """The phrases of a query: it is split at white space and at both quote characters. [SEA-1]"""
    return F.coalesce(F.regexp_extract_all(query, F.lit(f"(?U)({PHRASE})"), 1), F.array().cast("array<string>"))


def collapse_spaces(text: Column) -> Column:
    """One space for each run of white space, none at the ends. [TXT-2]"""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


# The patterns of the next function and their order, on which its results depend.
def slug(text: Column, most: int = 60) -> Column:
    """A file-name slug: lower case, words joined by single hyphens, at most `most` characters; 'untitled' if nothing is left. [TXT-1]"""
    low = F.regexp_replace(F.lower(text), r"(?U)^\s+|\s+$", "")
    joined = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"(?U)[^\w\s-]", ""), r"(?U)[\s_]+", "-"), "-+", "-")
    cut = F.regexp_replace(F.substring(joined, 1, most), r"^-+|-+$", "")
    return F.when(F.coalesce(cut, F.lit("")) == "", F.lit("untitled")).otherwise(cut)


def safe_file_name(text: Column, fallback: str = "report") -> Column:
    """A report's file name: characters that file systems refuse become a hyphen, a run of them one. [TXT-3, SNK-6]"""
    name = F.regexp_replace(F.trim(text), r'[<>:"/\\|?*\x00-\x1f]+', "-")
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit(fallback)).otherwise(name)


def safe_upload_name(name: Column) -> Column:
    """The last part of a path, where all but letters, digits, '.', '_' and '-' become '_'. [TXT-3]"""
    last = F.regexp_replace(F.regexp_extract(F.coalesce(name, F.lit("upload")), r"([^/]*)/*$", 1), r"[^\p{L}\p{N}._-]", "_")
    return F.when(last == "", F.lit("upload")).otherwise(last)


def quoted(text: Column) -> Column:
    """Text as a quoted literal: single quotes unless it has those and no double ones; backslashes, controls and what does not print escaped; None for null. [TXT-4]"""
    body = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    hidden = r"[\p{C}\p{Z}&&[^ ]]"

    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        digits = F.lower(F.hex(code))
        wide = F.when(code < 0x100, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0"))).when(code < 0x10000, F.concat(F.lit("\\u"), F.lpad(digits, 4, "0"))).otherwise(F.concat(F.lit("\\U"), F.lpad(digits, 8, "0")))
        return F.when(c.rlike(hidden), wide).otherwise(c)

    body = F.when(body.rlike(hidden), F.array_join(F.transform(F.split(body, ""), escaped), "")).otherwise(body)
    double = text.contains("'") & ~text.contains('"')
    return F.when(text.isNull(), F.lit("None")).when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))


def composed(text: Column) -> Column:
    """Text in Unicode's composed form (NFC), which Spark has no function for."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    return run(text)


# The patterns of the next function and their order, on which its results depend.
def highlight_terms(query: Column) -> Column:
    """The distinct terms to highlight, longest first: quoted strings or words, without punctuation at their ends. [SEA-7, SET-3]"""
    # Composing what stands between marks composes each term, as marks combine with nothing.
    raw = F.regexp_extract_all(composed(query), F.lit(r"""(?U)("[^"]+"|'[^']+'|[^\s]+)"""), 1)
    bare = F.transform(raw, lambda t: F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(t, r"""^["']|["']$""", "")), r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+$", ""))
    terms = F.array_distinct(F.filter(bare, lambda t: t != ""))
    ranked = F.array_sort(F.transform(terms, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t"))))
    return F.transform(ranked, lambda r: r["t"])


def mark_terms(text: Column, terms: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Text with all hits of any term marked, whatever their case: the earliest first, then the longest. Terms are literal. [SEA-8]"""
    literal = F.transform(terms, lambda t: F.concat(F.lit("\\Q"), F.replace(t, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    pattern = F.concat(F.lit("(?iu)("), F.array_join(literal, "|"), F.lit(")"))
    return F.when(F.size(terms) > 0, F.regexp_replace(text, pattern, F.lit(f"{before}$1{after}"))).otherwise(text)


# The patterns of the next function and their order, on which its results depend.
def compact_markdown(text: Column) -> Column:
    """An excerpt without markup that a cut would leave half open. [SEA-9]"""
    out = F.regexp_replace(text, "\uE200[^\uE201]*\uE201", "")
    out = F.regexp_replace(out, r"\*\*\[([^\]]+)\]\*\*", r"**\\[$1\\]**")
    out = F.regexp_replace(out, r"\s+---\s+", " · ")
    out = F.regexp_replace(out, r"(^|\r?\n)\s{0,3}#{1,6}\s+", "$1")
    out = F.regexp_replace(out, r"(\s)#{1,6}\s+", "$1")
    for marker in ("**", "```", "`"):
        times = (F.length(out) - F.length(F.replace(out, F.lit(marker), F.lit("")))) / len(marker)
        out = F.when(times % 2 == 1, F.replace(out, F.lit(marker), F.lit(""))).otherwise(out)
    return out


def citations(markdown: Column) -> Column:
    """The citations [id#mN] and [id#N] of a text in order, as structs (conversation_id, message_index). [INS-10]"""
    ids, at = (F.regexp_extract_all(markdown, F.lit(CITATION), n) for n in (1, 2))
    return F.zip_with(ids, at, lambda i, k: F.struct(i.alias("conversation_id"), k.cast("int").alias("message_index")))


def link_citations(markdown: Column) -> Column:
    """Citations as Markdown links to #source:id:N, the id percent-encoded: of the characters that it may have, that is ':' alone. [INS-10]"""
    # The text between citations, and each citation, in turn.
    between = F.split(markdown, CITATION)
    linked = F.zip_with(
        F.regexp_extract_all(markdown, F.lit(CITATION), 1), F.regexp_extract_all(markdown, F.lit(CITATION), 2),
        lambda i, k: F.concat(F.lit("["), i, F.lit(" #"), k, F.lit("](#source:"), F.replace(i, F.lit(":"), F.lit("%3A")), F.lit(":"), k, F.lit(")")),
    )
    return F.array_join(F.zip_with(between, linked, lambda t, c: F.concat(t, F.coalesce(c, F.lit("")))), "")


# The beginnings of links that are shown.
def safe_link(url: Column) -> Column:
    """The url if it is a fragment, a local path, http(s) or mailto; '' otherwise. [TXT-5]"""
    bare = F.regexp_replace(url, r"(?U)^\s+|\s+$", "")
    return F.when(bare.rlike(r"^(#|/(?!/)|https?://|mailto:)"), bare).otherwise("")


# The patterns of the next function and their order, on which its results depend.
def strip_inline_markdown(text: Column) -> Column:
    """Text of a heading: link texts, without escapes and emphasis marks."""
    out = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1")
    out = F.regexp_replace(out, r"\\([\\`*_\[\]{}()#+\-.!>])", "$1")
    return collapse_spaces(F.regexp_replace(out, r"[`*_~]", ""))


# The patterns of the next function and their order, on which its results depend.
def heading_slug(text: Column) -> Column:
    """The id of a heading before duplicates are numbered; 'section' if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.lower(composed(text)), r"[^\p{L}\p{N}]+", "-"), r"^-|-$", "")
    return F.when(out == "", F.lit("section")).otherwise(out)
