"""Headers of hiring posts: 'Company | Role | Place | REMOTE | pay'."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerframe.functions.parsers import arrangement, let, pay, shown_pay

# Words of roles and of employment, and what in an arrangement names no place.
ROLES = (
    "engineers?", "developers?", "scientists?", "researchers?", "designers?", "managers?", "lead", "head of", "architects?", "sre", "devops", "swe", "analysts?", "operators?", "founding", "staff",
    "principal", "interns?", "roles?", "positions?", "openings?", "cto", "vp",
)
EMPLOYMENT = ("full[- ]?time", "part[- ]?time", "contract(?:or)?", "intern(?:ship)?", "freelance", "b2b", "permanent")
NO_PLACE = r"(?i)\b(?:fully|remote|hybrid|on[\s-]?site|wfh|work from home|only|preferred|possible|friendly|ok)\b"
NO_PLACE_EITHER = r"(?i)[()/,+&-]|\bor\b|\band\b"
LINK = r"(?i)\bhttps?://[^\s|)]+"
#: Parts that a header has at least; characters of a company, of a place, of an employment.
LEAST_PARTS, COMPANY, PLACE, SHORT = 3, 80, 80, 60


def _either(words: tuple[str, ...]) -> str:
    return rf"(?i)\b(?:{'|'.join(words)})\b"


def header(line: Column) -> Column:
    """Parts of a post's first line: company, role, location, arrangement, pay, employment, url and the words of each; null if it is no header.

    Every part says what it could be. The first link is the link, and the first pay among the others the pay; of what
    is left, all roles add up, the last arrangement and the last employment count, and the first place does, be it a part
    of its own or named in an arrangement. A line of fewer than three parts, without a company, or without role,
    place and arrangement is no header.
    """
    cut = F.filter(F.transform(F.split(line, r"\|"), lambda p: F.trim(F.replace(p, F.lit("*"), F.lit("")))), lambda p: p != "")
    return let(F.when(F.size(cut) >= LEAST_PARTS, cut), lambda parts: let(F.transform(F.slice(parts, F.lit(2), F.size(parts)), _seen), lambda seen: _chosen(parts, seen)))


def _seen(p: Column, i: Column) -> Column:
    """What a part could be."""
    named = F.regexp_replace(F.regexp_replace(p, NO_PLACE, ""), NO_PLACE_EITHER, "").rlike("(?i)[a-z]{2,}")
    return F.struct(
        p.alias("text"), i.alias("i"), F.nullif(F.regexp_extract(p, LINK, 0), F.lit("")).alias("url"), pay(p).alias("pay"), p.rlike(_either(ROLES)).alias("role"), arrangement(p).alias("arrangement"),
        (p.rlike(_either(EMPLOYMENT)) & (F.length(p) < SHORT)).alias("employment"), named.alias("named"),
    )


def _first(x: Column) -> Column:
    return F.get(x, F.lit(0))


def _last(x: Column) -> Column:
    return F.get(x, F.size(x) - 1)


def _chosen(parts: Column, seen: Column) -> Column:
    """The link, then the pay among the other parts, then the rest."""
    link = lambda: _first(F.filter(seen, lambda x: x["url"].isNotNull()))
    paid = lambda u: _first(F.filter(seen, lambda x: x["pay"].isNotNull() & ~x["i"].eqNullSafe(u["i"])))
    rest = lambda u, q: F.filter(seen, lambda x: ~x["i"].eqNullSafe(u["i"]) & ~x["i"].eqNullSafe(q["i"]))
    return let(link(), lambda u: let(paid(u), lambda q: let(rest(u, q), lambda others: _named(parts, u, q, others))))


def _named(parts: Column, link: Column, paid: Column, rest: Column) -> Column:
    roles = F.filter(rest, lambda x: x["role"])
    arranged = F.filter(rest, lambda x: ~x["role"] & x["arrangement"].isNotNull())
    employed = _last(F.filter(rest, lambda x: ~x["role"] & x["arrangement"].isNull() & x["employment"]))
    place = _first(F.filter(rest, lambda x: ~x["role"] & F.when(x["arrangement"].isNotNull(), x["named"]).otherwise(~x["employment"] & (F.length(x["text"]) < PLACE))))
    company = F.trim(F.regexp_replace(_first(parts), r"\s*\([^)]*\)\s*$", ""))
    role = F.nullif(F.array_join(F.transform(roles, lambda x: x["text"]), "; "), F.lit(""))
    words = F.struct(_first(parts).alias("company"), _first(roles)["text"].alias("role"), place["text"].alias("location"), _first(arranged)["text"].alias("arrangement"), paid["pay"]["raw"].alias("pay"), employed["text"].alias("employment"), link["url"].alias("url"))
    found = F.struct(company.alias("company"), role.alias("role"), place["text"].alias("location"), _last(arranged)["arrangement"].alias("arrangement"), shown_pay(paid["pay"]).alias("pay"), employed["text"].alias("employment"), link["url"].alias("url"), words.alias("words"))
    is_header = lambda x: (x["company"] != "") & (F.length(x["company"]) <= COMPANY) & F.coalesce(x["role"], x["location"], x["arrangement"]).isNotNull()
    return let(found, lambda x: F.when(is_header(x), x))
