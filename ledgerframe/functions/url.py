"""URL functions on columns."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Query parameters that only track a click, besides every utm_ one; hosts under several names; hosts of
# four posting boards, by kind; document endings.
TRACKING = (
    "gh_src", "lever-origin", "lever-source", "lever-source[]", "ref",
    "fbclid", "gclid", "gclsrc", "dclid", "gbraid", "wbraid", "msclkid", "yclid", "twclid", "ttclid", "li_fat_id", "igshid", "si", "srsltid",
    "mc_cid", "mc_eid", "_hsenc", "_hsmi", "mkt_tok", "_ga", "_gl",
)
ALIASES = {"boards.greenhouse.io": "job-boards.greenhouse.io"}
APPLY_HOST = "jobs.lever.co"
BOARDS = {"job-boards.greenhouse.io": "greenhouse", "jobs.ashbyhq.com": "ashby", "jobs.lever.co": "lever", "apply.workable.com": "workable"}
DOCUMENTS = ("pdf", "xlsx", "csv", "json", "docx", "pptx")

_ABSOLUTE = r"^(?i:https?)://([^/?#]+)([^?#]*)(\?[^#]*)?"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(F.trim(url), _ABSOLUTE, i)


def host_of(url: Column) -> Column:
    """Lower-case host without credentials and port; null unless the URL is absolute http(s)."""
    host = F.lower(F.regexp_replace(F.regexp_replace(_part(url, 1), r"^.*@", ""), r":\d*$", ""))
    return F.when(host != "", host)


def site_of(url: Column) -> Column:
    """`host_of` without www., under the name that its aliases share."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    for name, same in ALIASES.items():
        host = F.when(host == name, same).otherwise(host)
    return host


def canonical_url(url: Column) -> Column:
    """One string for all addresses of a page; null unless the URL is absolute http(s).

    https, lower-case host without www. and default port, aliases unified, no fragment, no tracking parameters, the
    others sorted by key and otherwise in order, no trailing slashes. Percent codes stay as written.
    """
    port = F.regexp_extract(_part(url, 1), r":(\d+)$", 1)
    path = F.regexp_replace(_part(url, 2), "/+$", "")
    path = F.when(site_of(url) == APPLY_HOST, F.regexp_replace(path, "/apply$", "")).otherwise(path)
    parameters = F.filter(F.split(F.regexp_replace(_part(url, 3), r"^\?", ""), "&"), lambda p: p != "")
    key = lambda p: F.lower(F.element_at(F.split(p, "="), 1))
    kept = F.filter(parameters, lambda p: ~(key(p).startswith("utm_") | key(p).isin(*TRACKING)))
    ordered = F.array_sort(F.transform(kept, lambda p, i: F.struct(F.element_at(F.split(p, "="), 1).alias("k"), i.alias("i"), p.alias("p"))))
    query = F.array_join(F.transform(ordered, lambda s: s["p"]), "&")
    return F.concat(
        F.lit("https://"), site_of(url), F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))
    )


def url_pattern(url: Column) -> Column:
    """Host and one * for each path segment."""
    segments = F.filter(F.split(_part(url, 2), "/"), lambda s: s != "")
    return F.concat(host_of(url), F.array_join(F.transform(segments, lambda s: F.lit("/*")), ""))


def page_label(url: Column, most: int = 48) -> Column:
    """Host and path, cut to `most` characters."""
    return F.substring(F.concat(site_of(url), F.regexp_replace(_part(url, 2), "/$", "")), 1, most)


def parameter(url: Column, name: str) -> Column:
    """A query parameter's decoded value, null without one; unwraps redirect links."""
    value = F.regexp_extract(_part(url, 3), rf"[?&]{name}=([^&]*)", 1)
    return F.when(value != "", F.try_url_decode(value))


def board_of(url: Column) -> Column:
    """(kind, slug) of a posting board's URL, else null."""
    site = site_of(url)
    kind = F.coalesce(*[F.when(site == host, kind) for host, kind in BOARDS.items()])
    slug = F.lower(F.get(F.filter(F.split(_part(url, 2), "/"), lambda s: s != ""), F.lit(0)))
    return F.when(kind.isNotNull() & slug.isNotNull(), F.struct(kind.alias("kind"), slug.alias("slug")))


def document_kind(url: Column, content_type: Column | None = None) -> Column:
    """pdf, xlsx, csv, json ... by content type where it says so, else by the path's ending; null for others."""
    ending = F.lower(F.regexp_extract(_part(url, 2), r"\.([A-Za-z0-9]+)$", 1))
    by_path = F.when(ending.isin(*DOCUMENTS), ending)
    if content_type is None:
        return by_path
    kind = F.lower(content_type)
    by_type = F.when(kind.contains("pdf"), "pdf").when(kind.contains("spreadsheetml"), "xlsx").when(kind.contains("csv"), "csv").when(kind.contains("json"), "json")
    return F.coalesce(by_type, by_path)


@F.pandas_udf(T.StringType())
def _joined(base: pd.Series, link: pd.Series) -> pd.Series:
    def one(b: str | None, x: str | None) -> str | None:
        try:
            return None if x is None else urljoin(b or "", x)
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link)], dtype=object)


def absolute_url(base: Column, link: Column) -> Column:
    """The address that a link on a page leads to; null for a null link or one that can't be read. Absolute links stay as they are."""
    return F.when(link.rlike(r"^https?://[^/?#\[\]]+(?:[/?#]|$)"), link).otherwise(_joined(base, link))
