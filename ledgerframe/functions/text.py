"""Text functions on columns; those that Spark has no built-in for are Arrow UDFs."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from ledgerframe.functions.slices import sliced_udf

# Zero-width and bidirectional control characters; starts that a spreadsheet reads as a formula; what
# is written in full before texts are compared.
INVISIBLE = "[​-‍⁠﻿‪-‮⁦-⁩]"
IN_FULL = (("&", " and "), (r"\bsr\b\.?", "senior"), (r"\bjr\b\.?", "junior"))
FORMULA = "^(?:[\\t\\r]|\\s*[=+\\-@＝＋－＠])"


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Unicode NFKC; texts of ASCII alone are in that form and never leave Spark."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


@F.pandas_udf(T.StringType())
def decode_entities(text: pd.Series) -> pd.Series:
    """HTML entities as the characters they stand for."""
    return text.map(html.unescape, na_action="ignore")


def _each(texts: pd.Series, one: Callable[[str], str]) -> pd.Series:
    """What becomes of texts; those that repeat in a slice, as postings for several places do, are worked on once."""
    known = {t: one(t) for t in texts.dropna().unique()}
    return texts.map(known.__getitem__, na_action="ignore")


@sliced_udf(T.StringType())
def html_to_text(page: pd.Series) -> pd.Series:
    """Visible text of a page, a line for each block."""
    from ledgerframe.functions.dom import parse

    return _each(page, lambda p: parse(p).text())


@sliced_udf(T.StringType())
def coded_html_to_text(page: pd.Series) -> pd.Series:
    """The same of a page whose markup is escaped once more."""
    from ledgerframe.functions.dom import parse

    return _each(page, lambda p: parse(html.unescape(p)).text())


def normalize_chars(text: Column) -> Column:
    """One Unicode form, without invisible characters."""
    return F.regexp_replace(nfkc(text), INVISIBLE, "")


def collapse_lines(text: Column) -> Column:
    """Runs of spaces and tabs as one space, lines trimmed, blank lines dropped."""
    lines = F.transform(F.split(text, "\n"), lambda t: F.trim(F.regexp_replace(t, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda t: t != ""), "\n")


def normalize_whitespace(text: Column) -> Column:
    return collapse_lines(normalize_chars(text))


def single_line(text: Column) -> Column:
    """Runs of white space, line breaks of any kind included, as one space, trimmed."""
    return F.trim(F.regexp_replace(normalize_chars(text), r"[\s\u1680\u2028\u2029]+", " "))


def truncate(text: Column, most: int) -> Column:
    """At most `most` characters, cut at a space that lies beyond 60 % of them, with an ellipsis."""
    cut = F.substring(text, 1, most - 1)
    last = most - 1 - F.locate(" ", F.reverse(cut))  # place of the last space, from 0
    shorter = F.when((F.locate(" ", cut) > 0) & (last > most * 0.6), F.substring(text, F.lit(1), last)).otherwise(cut)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(shorter, F.lit("…")))


def spreadsheet_text(text: Column) -> Column:
    """A cell that no spreadsheet reads as a formula; null is empty."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), INVISIBLE, "")
    return F.when(clean.rlike(FORMULA), F.concat(F.lit("'"), clean)).otherwise(clean)


def csv_cell(text: Column) -> Column:
    """A guarded cell, quoted only where CSV asks for it."""
    cell = spreadsheet_text(text)
    return F.when(cell.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def normalize_text(text: Column) -> Column:
    """Form for comparing: lower case, & as and, sr and jr in full, all but a-z and 0-9 as single spaces."""
    t = F.lower(text)
    for short, full in IN_FULL:
        t = F.regexp_replace(t, short, full)
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of each lower-case word, padded with two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    pieces = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(pieces))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of both; 0 where neither has any."""
    x, y = trigrams(a), trigrams(b)
    either = F.size(F.array_union(x, y))
    return F.when(either > 0, F.size(F.array_intersect(x, y)) / either).otherwise(0.0)


def shared_terms(a: Column, b: Column) -> Column:
    """Distinct lower-case words that both texts have."""
    words = lambda t: F.filter(F.split(F.lower(t), "[^a-z0-9]+"), lambda w: w != "")
    return F.size(F.array_intersect(words(a), words(b)))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp similarity by characters, popular characters of long texts left out."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StructType().add("start", "integer").add("stop", "integer"))
def verify_quote(quote: pd.Series, text: pd.Series) -> pd.DataFrame:
    """Where a quote stands in the text as written, compared without case, spacing, and quote and dash variants; else null."""
    found = [_locate(q, t) for q, t in zip(quote, text)]
    return pd.DataFrame({"start": pd.array([f[0] if f else None for f in found], dtype="Int32"), "stop": pd.array([f[1] if f else None for f in found], dtype="Int32")})


_PLAIN = str.maketrans({**dict.fromkeys("‘’‚‛`´", "'"), **dict.fromkeys("“”„‟", '"'), **dict.fromkeys("‐‑‒–—―−", "-")})


class _Folds(dict):
    """What each character becomes in the comparable form, found once for each."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = "" if _HIDDEN.match(c) else "".join(" " if x.isspace() else x for x in unicodedata.normalize("NFKC", c).translate(_PLAIN).lower())
        return self[code]


_HIDDEN, _SPACES = re.compile(INVISIBLE), re.compile("  +")
_FOLDS = _Folds()


def _folded(text: str) -> str:
    """Comparable form."""
    return _SPACES.sub(" ", text.translate(_FOLDS))


def _locate(quote: str | None, text: str | None) -> tuple[int, int] | None:
    if quote is None or text is None:
        return None
    wanted = _folded(quote).strip()
    if len(wanted) < 2 or (at := _folded(text).find(wanted)) < 0:
        return None
    # Go along the text up to the quote's end, counting what the comparable form has.
    k, start, spaced = -1, None, False
    for i, c in enumerate(text):
        for x in _FOLDS[ord(c)]:
            if x == " " and spaced:
                continue
            spaced = x == " "
            k += 1
            if k == at:
                start = i
            if k == at + len(wanted) - 1:
                return start, i + 1


def located_phrases(text: Column, phrases: tuple[str, ...]) -> Column:
    """Where phrases stand in a text, whatever their case: an array of (start, k, stop), by start from 0; k is the phrase's number.

    Each phrase counts where it stands first. Of places that overlap the one that starts first is kept, of equal starts
    the phrase of the smaller number; blank phrases and those that the text lacks have no place. Null has none.
    """
    lower = F.lower(text)
    wanted = [(k, p.strip().lower()) for k, p in enumerate(phrases) if p.strip()]
    place = lambda k, p: F.struct((F.locate(p, lower) - 1).alias("start"), F.lit(k).alias("k"), (F.locate(p, lower) - 1 + len(p)).alias("stop"))
    kind = "array<struct<start: int, k: int, stop: int>>"
    spans = F.array_sort(F.filter(F.array(*[place(k, p) for k, p in wanted]).cast(kind), lambda s: s["start"] >= 0))
    free = lambda kept, s: F.coalesce(F.try_element_at(kept, F.lit(-1))["stop"] <= s["start"], F.lit(True))
    return F.coalesce(F.aggregate(spans, F.array().cast(kind), lambda kept, s: F.when(free(kept, s), F.array_append(kept, s)).otherwise(kept)), F.array().cast(kind))
