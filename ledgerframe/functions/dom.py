"""A small DOM on the standard parser, and what is read from a page."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import parse_qsl, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from ledgerframe.functions.slices import sliced_udf
from ledgerframe.functions.url import TRACKING

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tr", "ul"}
UNSEEN = {"script", "style", "noscript", "template", "head"}
#: Tags that a new tag of the same kind closes, and what closes an open paragraph.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Node:
    """An element: tag, attributes, children (elements and strings), parent."""

    def __init__(self, tag: str, attributes: dict | None = None, parent: Node | None = None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes or {}, parent, []

    def elements(self):
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def find(self, *tags: str):
        return [e for e in self.elements() if e.tag in tags]

    @property
    def hidden(self) -> bool:
        style = (self.attributes.get("style") or "").replace(" ", "").lower()
        return self.tag in UNSEEN or "hidden" in self.attributes or self.attributes.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style

    def text(self) -> str:
        """Visible text: blocks on lines of their own, spaces collapsed, no blank lines."""
        out: list[str] = []
        stack: list = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif not node.hidden or node is self:
                around = ["\n"] if node.tag in BLOCK else []
                stack += around + list(reversed(node.children)) + around
        lines = (re.sub(r"\s+", " ", line).strip() for line in re.sub(r"[^\S\n]+", " ", "".join(out)).split("\n"))
        return "\n".join(line for line in lines if line)

    def raw(self) -> str:
        return "".join(c if isinstance(c, str) else c.raw() for c in self.children)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("#root")

    def handle_starttag(self, tag, attrs):
        if self.open.tag == "p" and tag in BLOCK and tag != "br":
            self.open = self.open.parent
        elif self.open.tag in CLOSES.get(tag, ()):
            self.open = self.open.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open)
        self.open.children.append(node)
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.open
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.open = node.parent

    def handle_data(self, data):
        # A line break in the source is a space; only blocks part lines.
        self.open.children.append(data.replace("\n", " ").replace("\r", " ") if self.open.tag != "script" else data)


def parse(page: str | None) -> Node:
    builder = _Builder()
    builder.feed(page or "")
    builder.close()
    return builder.root


def title(root: Node) -> str | None:
    found = next((e.raw().strip() for e in root.find("title")), None)
    return re.sub(r"\s+", " ", found) if found else None


def json_ld(root: Node) -> list[str]:
    """Objects of all ld+json scripts, lists and @graph flattened, unreadable ones skipped."""
    found = []
    for e in root.find("script"):
        if e.attributes.get("type", "").lower() == "application/ld+json":
            try:
                ahead = [json.loads(e.raw())]
            except ValueError:
                continue
            while ahead:
                x = ahead.pop(0)
                if isinstance(x, list):
                    ahead = x + ahead
                elif isinstance(x, dict):
                    found.append(json.dumps({k: v for k, v in x.items() if k != "@graph"}, sort_keys=True, ensure_ascii=False)) if set(x) - {"@graph", "@context"} else None
                    ahead = list(x.get("@graph") or []) + ahead
    return found


# The assignments that hold a page's data; what holds the links to a list's other pages, by tag, class and role;
# what marks the current page; what a link to the next page is called; headings that name no one.
ASSIGNED = ("__appData", "__remixContext", "__INITIAL_STATE__", "__APOLLO_STATE__", "__NUXT__")
TURNING, CURRENT = ("nav", ("pagination", "pager"), "navigation"), ("current", "active")
NEXT = r"(?i)(?:next|older)\b.*|.*[»›→]"
GENERIC = r"(?i)careers?|jobs?|open (?:roles|positions)|join us|work with us|home"


def measures(root: Node) -> dict[Node, tuple[int, int, bool, bool, bool]]:
    """For each element, from the leaves up: letters and words of its visible text, whether it starts and ends with a space, whether it holds a link.

    The text's length is letters plus words less one, as one space or line break stands between two words.
    """

    def joined(x: tuple, y: tuple) -> tuple:
        link = x[4] or y[4]
        if not x[1]:
            space = x[2] or y[2]
            return y[0], y[1], space, y[3] if y[1] else space, link
        if not y[1]:
            return x[0], x[1], x[2], x[3] or y[2], link
        return x[0] + y[0], x[1] + y[1] - (not (x[3] or y[2])), x[2], y[3], link

    found: dict[Node, tuple] = {}
    for node in reversed([root, *root.elements()]):  # children come after their parents
        total = (0, 0, False, False, False)
        for c in node.children:
            if isinstance(c, str):
                part = (sum(map(len, c.split())), len(c.split()), c[:1].isspace(), c[-1:].isspace(), False) if c else total
                total = joined(total, part) if c else total
            elif not c.hidden:
                total = joined(total, found[c])
            elif found[c][4]:
                total = (*total[:4], True)
        if node.tag in BLOCK:
            total = (*total[:2], True, True, total[4])
        found[node] = (*total[:4], total[4] or node.tag == "a")
    return found


def embedded(root: Node) -> list[tuple[str, str]]:
    """(name, JSON) of the data that scripts hold: __NEXT_DATA__, and objects assigned to the known names; unreadable ones are skipped."""
    found = []
    for e in root.find("script"):
        text = e.raw()
        if e.attributes.get("id") == "__NEXT_DATA__":
            found.append(("__NEXT_DATA__", text))
        if not e.attributes.get("src"):
            found += [(name, _balanced(text, m.end() - 1)) for name in ASSIGNED if (m := re.search(rf"{name} ?=[^{{]*{{", text))]
    out = []
    for name, text in found:
        try:
            out.append((name, json.dumps(json.loads(text), ensure_ascii=False)))
        except ValueError:
            continue
    return out


def _balanced(text: str, start: int) -> str:
    """The object that opens at `start`; braces within strings don't count."""
    depth = 0
    for m in re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|[{}]", re.S).finditer(text, start):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth:
            return text[start : m.end()]
    return ""


def same_page(one: str, other: str) -> bool:
    """Whether two addresses are one page: scheme, www., fragment, tracking and a last slash aside."""

    def form(url: str) -> tuple:
        u = urlsplit(url)
        query = sorted(p for p in parse_qsl(u.query, keep_blank_values=True) if p[0].lower() not in TRACKING and not p[0].lower().startswith("utm_"))
        return (u.hostname or "").removeprefix("www."), u.port, u.path.rstrip("/"), query

    return form(one) == form(other)


def next_page(root: Node, url: str) -> str | None:
    """The page after this one in a list, never this one itself; null without.

    A link marked as next leads there. Else, among the links that turn the list's pages, one that is called next or older
    or ends in an arrow, or else the one numbered one past the current page, which is the first without a mark.
    """

    def led(e: Node | None) -> str | None:
        to = urljoin(url, e.attributes["href"]) if e is not None else ""
        return to if urlsplit(to).scheme in ("http", "https") and not same_page(to, url) else None

    def within(tops: list[Node]) -> list[Node]:
        return list(dict.fromkeys(e for top in tops for e in top.elements()))

    named = lambda e: e.attributes.get("class", "").split()
    line = lambda e: re.sub(r"\s+", " ", e.text()).strip()
    marked = next((e for e in root.find("a", "link") if "href" in e.attributes and "next" in e.attributes.get("rel", "").lower().split()), None)
    tag, classes, role = TURNING
    turning = within([e for e in root.elements() if e.tag == tag or e.attributes.get("role") == role or set(classes) & set(named(e))])
    labelled = [(line(e) or e.attributes.get("aria-label", "").strip(), e) for e in turning if e.tag == "a" and e.attributes.get("href")]
    if to := led(marked):
        return to
    if following := next((e for label, e in labelled if re.fullmatch(NEXT, label)), None):
        return led(following)
    now = next((line(e) for e in turning if e.attributes.get("aria-current") == "page" or set(CURRENT) & set(named(e))), "")
    number = str(int(now) + 1 if now.isdecimal() and int(now) else 2)
    return led(next((e for label, e in labelled if label == number), None))


def site_owner(root: Node) -> str | None:
    """Who a site belongs to: the site name that it declares, else its first heading, else the start of its title; null if none is plausible."""
    said = [e.attributes.get("content", "") for key, name in (("property", "og:site_name"), ("name", "application-name")) for e in root.find("meta") if e.attributes.get(key) == name]
    lead = re.split(r"\s+[|\-–—:]\s+", (title(root) or "").strip())[0]
    declared = next((x for x in said if x.strip()), "")
    for name in (declared, *(e.text() for e in root.find("h1")[:1]), lead):
        name = re.sub(r"\s+", " ", name).strip()
        if 2 <= len(name) <= 60 and len(name.split()) <= 6 and not re.fullmatch(GENERIC, name):
            return name
    return None


def _links(root: Node, url: str) -> list[str]:
    found = (urljoin(url, e.attributes["href"]) for e in root.find("a") if e.attributes.get("href"))
    return [x for x in found if urlsplit(x).scheme in ("http", "https")]


def canonical_link(root: Node, url: str) -> str | None:
    """The address that a page calls its own, if it is on the same host (www. aside)."""
    href = next((e.attributes.get("href") for e in root.find("link") if "canonical" in e.attributes.get("rel", "").lower().split()), None)
    own = urljoin(url, href) if href else None
    host = lambda u: (urlsplit(u).hostname or "").removeprefix("www.")
    return own if own and host(own) == host(url) else None


_S, _L = T.StringType(), T.ArrayType(T.StringType())
#: What a page can be asked for: how it is read from the parsed page and its address, and its type.
FACETS = {
    "title": (lambda r, u: title(r), _S), "text": (lambda r, u: r.text(), _S), "headings": (lambda r, u: [e.text() for e in r.find("h1", "h2", "h3")], _L), "links": (_links, _L),
    "json_ld": (lambda r, u: json_ld(r), _L), "embedded": (lambda r, u: [dict(zip(("name", "data"), x)) for x in embedded(r)], T.ArrayType(T.StructType().add("name", "string").add("data", "string"))),
    "next_page": (next_page, _S), "owner": (lambda r, u: site_owner(r), _S), "canonical": (canonical_link, _S),
}


def state(page: str | None, url: str | None, facets: tuple[str, ...] = tuple(FACETS)) -> dict:
    """What a page is asked for, parsed once."""
    root = parse(page)
    return {f: FACETS[f][0](root, url or "") for f in facets}


def page_facets(*facets: str):
    """A column function (page, url) -> struct of the facets asked for; the others cost nothing."""
    kind = T.StructType([T.StructField(f, FACETS[f][1]) for f in facets])

    @sliced_udf(kind)
    def run(page: pd.Series, url: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([state(p, u, facets) for p, u in zip(page, url)], columns=list(facets))

    return run


def page_state(page: Column, url: Column) -> Column:
    """All facets of a page, and a hash of its text."""
    s = page_facets(*FACETS)(page, url)
    return s.withField("hash", F.sha2(s["text"], 256))
