"""Readers of schema.org objects, as columns over their JSON."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def of_type(objects: Column, name: str) -> Column:
    """The objects of a type, which may be one of several."""
    return F.filter(objects, lambda o: F.coalesce(F.get_json_object(o, "$.@type"), F.lit("")).rlike(rf'(?:^|"){name}(?:"|$)'))


def value(thing: Column, *paths: str) -> Column:
    """The first path with text, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(thing, f"$.{p}")), F.lit("")) for p in paths])


def job_posting(thing: Column) -> dict[str, Column]:
    """Fields of a JobPosting: title, company, location, arrangement, employment, posted, salary bounds, currency and url."""
    place = F.concat_ws(", ", *[value(thing, f"jobLocation.address.{p}", f"jobLocation[0].address.{p}") for p in ("addressLocality", "addressRegion", "addressCountry")])
    number = lambda *paths: value(thing, *paths).try_cast("double")
    low, high = number("baseSalary.value.minValue", "baseSalary.value.value", "baseSalary.minValue"), number("baseSalary.value.maxValue", "baseSalary.value.value", "baseSalary.maxValue")
    return {
        "title": value(thing, "title", "name"), "company": value(thing, "hiringOrganization.name", "hiringOrganization"), "location": F.nullif(place, F.lit("")),
        "arrangement": F.when(value(thing, "jobLocationType") == "TELECOMMUTE", "remote"), "employment": value(thing, "employmentType[0]", "employmentType"),
        "posted": value(thing, "datePosted"), "salary_low": F.coalesce(low, high), "salary_high": F.coalesce(high, low), "currency": value(thing, "baseSalary.currency"), "url": value(thing, "url"),
    }


def by_name(thing: Column, field: str, hints: dict[str, tuple[str, ...]]) -> Column:
    """A field of any object: its namesake, else the properties that words of its name hint at."""
    words = field.lower().split("_")
    camel = words[0] + "".join(w.capitalize() for w in words[1:])
    return value(thing, field, camel, *[p for w in words for p in hints.get(w, ())])


def item_list(objects: Column) -> Column:
    """Entries of ItemLists as JSON objects, in order."""
    parse = lambda o: F.from_json(F.get_json_object(o, "$.itemListElement"), "array<string>")
    return F.flatten(F.transform(of_type(objects, "ItemList"), lambda o: F.coalesce(parse(o), F.array().cast("array<string>"))))


def ladder(rungs: list[tuple[str, dict[str, Column]]], fields: list[str]) -> dict[str, Column]:
    """For each field a struct (value, method): the first rung that has it; null where none does."""
    out = {}
    for f in fields:
        tried = [F.when(columns[f].isNotNull(), F.struct(columns[f].cast("string").alias("value"), F.lit(method).alias("method"))) for method, columns in rungs if f in columns]
        out[f] = F.coalesce(*tried) if tried else F.lit(None).cast("struct<value:string,method:string>")
    return out
