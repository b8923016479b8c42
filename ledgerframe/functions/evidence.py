"""Values with the proof of where they come from, as structs of columns, and whether a quote states a value."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F

from ledgerframe.functions.parsers import arrangement, let, pay, shown_pay
from ledgerframe.functions.text import truncate

#: Characters of a snippet that are kept.
SNIPPET = 300


class Proof(NamedTuple):
    """A value and the words that state it."""

    value: Column
    quote: Column


def _value(value: Column, method: str, snippet: Column, locator: Column, verified: Column, url: Column) -> Column:
    """A struct (value, method, snippet, locator, verified, url); null where the value is null or blank."""
    text = value.cast("string")
    made = F.struct(text.alias("value"), F.lit(method).alias("method"), truncate(snippet, SNIPPET).alias("snippet"), locator.alias("locator"), F.coalesce(verified, F.lit(False)).alias("verified"), url.alias("url"))
    return F.when(F.coalesce(F.trim(text), F.lit("")) != "", made)


def from_api(value: Column, path: Column, url: Column) -> Column:
    """A value of a feed, at a JSON path."""
    return _value(value, "API", value.cast("string"), path, F.lit(True), url)


def derived(value: Column, source: Column, url: Column) -> Column:
    """A value worked out from others."""
    return _value(value, "DERIVED", source, F.lit("derived"), F.lit(True), url)


def doc_meta(value: Column, detail: str, snippet: Column, url: Column) -> Column:
    """A value that a file states of itself, such as in a header."""
    return _value(value, "DOC_META", snippet, F.lit(detail), F.lit(True), url)


def from_text(proof: Proof, text: Column, url: Column, method: str = "REGEX") -> Column:
    """A value read from a text: its locator is the span of the quote's first place, and it is verified if there is one."""
    start = F.instr(text, proof.quote) - 1  # null without a quote
    found = (start >= 0) & (F.length(proof.quote) > 0)
    span = F.concat_ws("-", start.cast("string"), (start + F.length(proof.quote)).cast("string"))
    return _value(proof.value, method, proof.quote, F.when(found, span).otherwise("header"), found, url)


def searched(proof: Proof, text: Column, url: Column) -> Column:
    """A value read from a search result's own text; without a quote there is none."""
    return F.when(F.coalesce(proof.quote, F.lit("")) != "", from_text(proof, text, url, "SEARCH"))


def compact(fields: dict[str, Column]) -> Column:
    """A map of the fields that have a value."""
    whole = F.create_map(*[x for name, c in fields.items() for x in (F.lit(name), c)])
    return F.map_filter(whole, lambda _, v: v.isNotNull())


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits, commas within numbers dropped."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), r"(\d),(?=\d)", "$1"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def quote_supports(value: Column, quote: Column, kind: str = "text") -> Column:
    """Whether a quote states a value: the same pay or the same arrangement, else every word of the value."""
    if kind == "pay":
        bounds = F.struct(pay(value).alias("a"), pay(quote).alias("b"))
        return let(bounds, lambda x: F.coalesce((x["a"]["least"] == x["b"]["least"]) & (x["a"]["most"] == x["b"]["most"]), F.lit(False)))
    if kind == "arrangement":
        return F.coalesce(arrangement(quote) == F.coalesce(arrangement(value), F.lower(F.trim(value))), F.lit(False))
    return F.size(F.array_except(words_of(value), words_of(quote))) == 0


def normal_pay(text: Column) -> Column:
    """Pay in its one form, or the text as it stands."""
    return F.coalesce(shown_pay(pay(text)), F.trim(text))


def model_values(rows: Column, text: Column, url: Column, start: Column, stop: Column, kind: str = "text") -> Column:
    """A model's answer (value, quote) as a value with proof, kept only if its quote stands in the text and states the value."""
    quoted = F.substring(text, start + 1, stop - start)
    kept = start.isNotNull() & quote_supports(rows["value"], quoted, kind)
    return F.when(kept, _value(rows["value"], "LLM", quoted, F.concat_ws("-", start.cast("string"), stop.cast("string")), F.lit(True), url))
