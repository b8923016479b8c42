"""Plain walks over a parsed page, which the tests hold the joins on element rows against."""

import re
from urllib.parse import urljoin

from ledgerframe.functions import dom
from ledgerframe.operators import elements, paths


def visible(root):
    """Visible elements in document order, with their visible parents' numbers."""
    out, numbers = [], {}

    def go(node, parent):
        for c in node.children:
            if isinstance(c, dom.Node) and not c.hidden:
                numbers[c] = len(out)
                out.append((c, parent))
                go(c, numbers[c])

    go(root, -1)
    return out


def generated(name):
    return any(re.search(form, name) for form in elements.GENERATED)


def own_selector(e):
    quoted = lambda a: f'{e.tag}[{a}="' + e.attributes[a].replace("\\", "\\\\").replace('"', '\\"') + '"]'
    for a in elements.STABLE:
        if e.attributes.get(a):
            return quoted(a), False
    names = [c for c in re.split(r"\s+", e.attributes.get("class", "")) if re.fullmatch(r"-?[_a-zA-Z][\w-]*", c)]
    steady = [c for c in names if not generated(c)]
    if steady:
        return ".".join([e.tag, *steady[:2]]), False
    if e.attributes.get("role"):
        return quoted("role"), False
    return (e.tag + "." + names[0], True) if names else (e.tag, False)


class Page:
    def __init__(self, html, url="https://a.example/x"):
        self.url = url
        self.nodes = [n for n, _ in visible(dom.parse(html))]
        self.parent = {n: p for n, (_, p) in enumerate(visible(dom.parse(html)))}
        self.number = {n: i for i, n in enumerate(self.nodes)}

    def last(self, i):
        return max([i, *(self.last(k) for k, p in self.parent.items() if p == i)])

    def nth(self, i):
        return sum(1 for k, p in self.parent.items() if p == self.parent[i] and k <= i and self.nodes[k].tag == self.nodes[i].tag)

    def fits(self, i, step):
        _, tag, classes, tests, nth = step
        a = self.nodes[i].attributes
        ok = (tag is None or tag == self.nodes[i].tag) and set(classes) <= set(a.get("class", "").split())
        for name, op, value in tests:
            ok = ok and name in a and (op == "" or (op == "=" and a[name] == value) or (op == "*=" and value != "" and value in a[name]))
        return ok and (nth is None or self.nth(i) == nth)

    def select(self, selector, top=-1):
        """Numbers of the elements below `top` that a path finds; every step lies below `top`."""
        found = {top}
        for step in paths.parse(selector):
            found = {i for i in self.parent if self.fits(i, step) and any(self.parent[i] == f if step[0] else self.under(i, f) for f in found)}
        return sorted(found)

    def under(self, i, top):
        while i >= 0:
            i = self.parent[i]
            if i == top:
                return True
        return False

    def value(self, item, selector, attribute):
        found = self.select(selector, item) if selector else [item]
        if not found:
            return None
        e = self.nodes[found[0]]
        value = e.attributes.get(attribute) if attribute else e.text()
        if not value or not value.strip():
            return None
        return urljoin(self.url, value.strip()) if attribute in ("href", "src") else value.strip()

    def replay(self, items, fields):
        return [{f: self.value(i, *v) for f, v in fields.items()} for i in self.select(items)]


def repeated_groups(page):
    """(selector, items, mean text, links an item, score) of alike siblings, best first."""
    found = {}
    for i, node in enumerate(page.nodes):
        found.setdefault((page.parent[i], own_selector(node)), []).append(node)
    out = []
    for (_, (name, fragile)), nodes in found.items():
        mean = sum(len(n.text()) for n in nodes) / len(nodes)
        if len(nodes) >= 3 and mean >= 8:
            links = sum(n.tag == "a" or bool(n.find("a")) for n in nodes) / len(nodes)
            score = len(nodes) * min(mean, 200) * (0.5 + links) * (1 if "." in name or "[" in name else 0.3) * (0.8 if fragile else 1)
            out.append((name, len(nodes), round(mean, 6), round(links, 6), round(score, 6)))
    return sorted(out, key=lambda g: (-g[4], g[0]))
