"""Whether a page holds what it should: rendered content, no bot check or wall, a public address; texts of documents."""

from __future__ import annotations

import ipaddress
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Shells of pages that scripts fill, marks of bot checks, of captchas and of walls, statuses that refuse,
# networks that aren't public, words that carry no meaning.
SHELLS = (r"(?i)<div[^>]+id=[\"'](?:root|app|__next|__nuxt|svelte)[\"'][^>]*>\s*</div>", r"(?i)enable javascript|javascript is required|requires javascript")
CHALLENGES = ("<title>Just a moment...</title>", "_cf_chl_opt", "cType: '", "captcha-delivery.com", 'id="px-captcha"', "<TITLE>Access Denied</TITLE>")
CAPTCHAS = ("google.com/recaptcha/", "recaptcha.net/recaptcha/", "hcaptcha.com/1/api.js")
WALLS = ("consent.google.com/save", "consent.youtube.com/save", "collectConsent?sessionId=", 'content="auth_wall_')
REFUSING = (403, 429, 503)
INTERNAL = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16", "198.18.0.0/15", "224.0.0.0/3",
    "::/128", "::1/128", "::ffff:0:0:0/96", "64:ff9b:1::/48", "2001::/32", "fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8",
)
#: IPv6 networks that carry an IPv4 address, and how far right it stands.
CARRYING = (("::ffff:0:0/96", 0), ("::/96", 0), ("64:ff9b::/96", 0), ("2002::/16", 80))
STOPWORDS = ("a", "an", "and", "are", "as", "at", "by", "for", "from", "in", "is", "of", "on", "or", "the", "to", "with")
#: Characters of text below which a page needs rendering, and below which it does if it looks like a shell.
LEAST, SHELL = 500, 2_000


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for mark in marks:
        found = found | F.contains(text, F.lit(mark))
    return found


def needs_render(html: Column, text_length: Column) -> Column:
    """Why a page must be rendered to be read ('little text', 'shell'), null if it needn't."""
    shell = F.coalesce(html.rlike(SHELLS[0]) | html.rlike(SHELLS[1]), F.lit(False))
    return F.when(text_length < LEAST, "little text").when((text_length < SHELL) & shell, "shell")


def has_challenge(body: Column) -> Column:
    """Marks of a bot check or a wall in a page itself."""
    return _any(body, CHALLENGES) | _any(body, WALLS)


def is_challenge(status: Column, mitigated: Column, body: Column) -> Column:
    """A wall, or a bot check with a refusing status, in place of the page."""
    return _any(body, WALLS) | (status.isin(*REFUSING) & (F.coalesce(mitigated == "challenge", F.lit(False)) | _any(body, CHALLENGES) | _any(body, CAPTCHAS)))


_NETWORKS = [ipaddress.ip_network(n) for n in INTERNAL]
_CARRIERS = [(ipaddress.ip_network(n), shift) for n, shift in CARRYING]


def _internal(text: str | None) -> bool | None:
    if text is None:
        return None
    try:
        address = ipaddress.ip_address(text.split("%")[0])
    except ValueError:
        return True  # what can't be read isn't trusted
    if any(address.version == n.version and address in n for n in _NETWORKS):
        return True
    for network, shift in _CARRIERS:
        if address.version == 6 and address in network:
            return _internal(str(ipaddress.IPv4Address(int(address) >> shift & 0xFFFFFFFF)))
    return False


@F.pandas_udf(T.BooleanType())
def is_internal(address: pd.Series) -> pd.Series:
    """Whether an IP address is not a public one, also where an IPv6 address carries an IPv4 one; unreadable ones count as internal."""
    return address.map(_internal)


_UNSEEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f­​-‏‪-‮⁠⁦-⁩﻿\ud800-\udfff]")
_BROKEN = re.compile(r"(?<=\w)[-­‐‑][ \t]*\n[ \t]*(?=(\w))")


@F.pandas_udf(T.StringType())
def document_text(text: pd.Series) -> pd.Series:
    """A document's text in one Unicode form, without invisible characters, words broken across lines joined if they go on in lower case."""
    clean = lambda t: _UNSEEN.sub("", _BROKEN.sub(lambda m: "" if m[1].islower() else m[0], unicodedata.normalize("NFKC", t)))
    return text.map(clean, na_action="ignore")


def terms(text: Column) -> Column:
    """Distinct lower-case words that carry meaning."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*STOPWORDS)))


def shared(text: Column, query: str) -> Column:
    """How many of a query's words a text has."""
    return F.size(F.array_intersect(terms(text), terms(F.lit(query))))


def ago(at: Column, now: Column) -> Column:
    """'3 days ago', 'yesterday', 'in 2 hours', 'just now': rounded in the largest unit that fits."""
    half_up = lambda x: F.floor(x + 0.5)
    seconds = half_up((F.unix_micros(at) - F.unix_micros(now)) / 1e6)

    def said(unit: str, size: int) -> Column:
        n = half_up(seconds / size)
        many = F.abs(n)
        text = F.concat_ws(" ", many.cast("string"), F.when(many == 1, unit).otherwise(unit + "s"))
        plain = F.when(n < 0, F.concat(text, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), text))
        return F.when(n == -1, "yesterday").when(n == 1, "tomorrow").otherwise(plain) if unit == "day" else plain

    return F.when(F.abs(seconds) >= 86_400, said("day", 86_400)).when(F.abs(seconds) >= 3_600, said("hour", 3_600)).when(F.abs(seconds) >= 60, said("minute", 60)).otherwise("just now")


def lasted(start: Column, end: Column) -> Column:
    """'45s' or '3m 5s'; null without a start."""
    s = F.greatest(F.lit(0), F.round(F.unix_micros(end) / 1e6 - F.unix_micros(start) / 1e6)).cast("long")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))


def dollars(amount: Column) -> Column:
    return F.when((amount < 0.01) & (amount > 0), "< $0.01").otherwise(F.concat(F.lit("$"), F.format_string("%.2f", amount)))
