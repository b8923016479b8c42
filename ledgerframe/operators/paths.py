"""Selectors evaluated as joins on element rows: descendants by nested intervals, children by their parent, places by windows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: A step: whether it goes to children only, the tag (or null), classes, attribute tests (name, operator, value; the operator
#: is '' for presence), place among siblings of the tag (or null).
STEP = "struct<child: boolean, tag: string, classes: array<string>, tests: array<struct<name: string, op: string, value: string>>, nth: int>"
STEPS = f"array<{STEP}>"

_SIMPLE = re.compile(r"""(?P<tag>^[a-zA-Z][\w-]*|^\*)|\.(?P<class>-?[_a-zA-Z][\w-]*)|\#(?P<id>[\w-]+)|\[(?P<name>[\w-]+)(?:(?P<op>[*]?=)(?:"(?P<quoted>(?:\\.|[^"\\])*)"|(?P<bare>[^\]]*)))?\]|:nth-of-type\((?P<nth>\d+)\)""")


def parse(selector: str) -> list[tuple]:
    """The steps of a path of simple selectors (tag, .class, #id, [attribute], =, *=, :nth-of-type), joined by spaces or >."""
    steps, child, at = [], False, 0
    for part in re.findall(r"""\s*>\s*|\s+|(?:\[(?:"(?:\\.|[^"\\])*"|[^\]"])*\]|[^\s>\[])+""", selector.strip()):
        if not part.strip():
            continue
        if part.strip() == ">":
            child = True
            continue
        tag, classes, tests, nth, at = None, [], [], None, 0
        while at < len(part):
            m = _SIMPLE.match(part, at) if at else _SIMPLE.match(part)
            if not m or m.end() == at:
                raise ValueError(f"no simple selector: {part}")
            if m["tag"]:
                tag = None if m["tag"] == "*" else m["tag"].lower()
            elif m["class"]:
                classes.append(m["class"])
            elif m["id"]:
                tests.append(("id", "=", m["id"]))
            elif m["name"]:
                value = re.sub(r"\\(.)", r"\1", m["quoted"]) if m["quoted"] is not None else (m["bare"] or "").strip("'")
                tests.append((m["name"].lower(), m["op"] or "", value))
            else:
                nth = int(m["nth"])
            at = m.end()
        steps.append((child, tag, classes, tests, nth))
        child = False
    return steps


def steps(selector: str) -> Column:
    """The steps of a selector as a column."""
    text = lambda v: F.lit(v).cast("string")
    tests = lambda ts: F.array(*[F.struct(text(n).alias("name"), text(o).alias("op"), text(v).alias("value")) for n, o, v in ts])
    made = [F.struct(F.lit(c), text(t), F.array(*map(text, k)).cast("array<string>"), tests(ts).cast("array<struct<name: string, op: string, value: string>>"), F.lit(n).cast("int")) for c, t, k, ts, n in parse(selector)]
    return F.array(*made).cast(STEPS)


def own_step(rows: Column | str, child: bool = False, nth: Column | None = None) -> Column:
    """The step that a selector of one element stands for (`selector` as `elements.selector_of` writes it), from data."""
    s = F.col(rows) if isinstance(rows, str) else rows
    tag = F.regexp_extract(s, r"^([^.\[]+)", 1)
    attribute = F.regexp_extract(s, r"^[^.\[]+\[([^=]+)=", 1)
    value = F.regexp_replace(F.regexp_extract(s, r'="((?:\\.|[^"\\])*)"\]$', 1), r"\\(.)", "$1")
    classes = F.when(attribute == "", F.filter(F.split(F.regexp_replace(s, r"^[^.]+", ""), r"\."), lambda c: c != ""))
    test = F.when(attribute != "", F.array(F.struct(attribute.alias("name"), F.lit("=").alias("op"), value.alias("value"))))
    empty = "array<struct<name: string, op: string, value: string>>"
    return F.struct(F.lit(child), tag, F.coalesce(classes, F.array().cast("array<string>")), F.coalesce(test, F.array().cast(empty)), (F.lit(None) if nth is None else nth).cast("int")).cast(STEP)


def placed(rows: DataFrame) -> DataFrame:
    """Add `nth`, the place of each element among the siblings of its tag, from 1."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy("page_id", "parent", "tag").orderBy("i")))


def _fits(step: Column) -> Column:
    """Whether the row's element (tag, attributes, nth) passes a step."""
    own = F.split(F.coalesce(F.col("attributes")["class"], F.lit("")), r"\s+")

    def passes(t: Column) -> Column:
        value = F.element_at(F.col("attributes"), t["name"])
        return F.when(t["op"] == "=", value == t["value"]).when(t["op"] == "*=", (t["value"] != "") & F.contains(value, t["value"])).otherwise(value.isNotNull())

    return (
        F.coalesce(F.col("tag") == step["tag"], F.lit(True))
        & (F.size(F.array_except(step["classes"], own)) == 0)
        & F.forall(step["tests"], lambda t: F.coalesce(passes(t), F.lit(False)))
        & F.coalesce(F.col("nth") == step["nth"], F.lit(True))
    )


def select(rows: DataFrame, asks: DataFrame) -> DataFrame:
    """What each ask (page_id, key, i, last, steps) finds below element i: page_id, key, i (the element found), last.

    `rows` are elements with `nth` (see `placed`); i -1 with last beyond all stands for the page. Each distinct simple
    selector of a page is tested once on the page's elements. A step to descendants then joins the found intervals
    that lie in the last ones, a step to children those whose parent was found; many selectors go along in one pass. An
    ask without steps finds the element itself.
    """
    step = F.explode("steps").alias("step")
    name = lambda c: F.to_json(c.dropFields("child"))
    wanted = asks.select("page_id", step).select("page_id", name(F.col("step")).alias("test"), F.col("step").dropFields("child").alias("step")).dropDuplicates(["page_id", "test"])
    hits = rows.select("page_id", "i", "last", "parent", "tag", "attributes", "nth").join(wanted, "page_id").filter(_fits(F.col("step"))).select("page_id", "test", F.col("i").alias("_i"), F.col("last").alias("_last"), "parent")
    longest = asks.agg(F.max(F.size("steps"))).first()[0] or 0
    now = asks.select("page_id", "key", "i", "last", "steps", F.lit(0).alias("k"))
    for k in range(longest):
        ended, ahead = now.filter(F.size("steps") <= k), now.filter(F.size("steps") > k)
        ahead = ahead.select("page_id", "key", "i", "last", "steps", name(F.get("steps", F.lit(k))).alias("test"), F.get("steps", F.lit(k))["child"].alias("child"))
        below = F.when(F.col("child"), F.col("parent") == F.col("i")).otherwise((F.col("_i") > F.col("i")) & (F.col("_i") <= F.col("last")))
        found = ahead.join(hits, ["page_id", "test"]).filter(below).select("page_id", "key", F.col("_i").alias("i"), F.col("_last").alias("last"), "steps", F.lit(k + 1).alias("k"))
        now = ended.unionByName(found.dropDuplicates(["page_id", "key", "i"]))
    return now.select("page_id", "key", "i", "last")


def page_asks(pages: DataFrame, *selectors: str) -> DataFrame:
    """Asks of whole pages (page_id), one for each selector, with the selector as key."""
    every = F.explode(F.array(*[F.struct(F.lit(s).alias("key"), steps(s).alias("steps")) for s in dict.fromkeys(selectors)])).alias("a")
    return pages.select("page_id", every).select("page_id", "a.key", F.lit(-1).alias("i"), F.lit(1 << 30).alias("last"), "a.steps")
