"""Pages read by the fold against a plain reader with a stack of its own, on the given pages and on broken nesting."""

import html as entities
import os
import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tarnlake.operators import html as H

PAGES = "/root/testdata/sf0.001/pages.parquet"


class Reader(HTMLParser):
    """Builds a tree by the same lenient rules."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.top = {"name": "", "attrs": {}, "kids": [], "up": None}

    def handle_starttag(self, tag, attrs):
        node = {"name": tag, "attrs": {k: v or "" for k, v in attrs}, "kids": [], "up": self.top}
        if tag in H.HEADINGS:  # a heading ends where another begins
            up = self.top
            while up:
                if up["name"] in H.HEADINGS:
                    up["ended"] = up.get("ended") or node
                up = up["up"]
        self.top["kids"].append(node)
        if tag not in H.VOID and not self.get_starttag_text().endswith("/>"):
            self.top = node

    def handle_startendtag(self, tag, attrs):
        self.top["kids"].append({"name": tag, "attrs": {k: v or "" for k, v in attrs}, "kids": [], "up": self.top})

    def handle_endtag(self, tag):
        at = self.top
        while at and at["name"] != tag:
            at = at["up"]
        if at and at["up"]:
            self.top = at["up"]

    def handle_data(self, data):
        self.top["kids"].append(data)


def plain(t):
    return re.sub(r"[\s\xa0]+", " ", t).strip(" ")


def walk(node, up=()):
    for kid in node["kids"]:
        if isinstance(kid, str):
            yield kid, (*up, node)
        else:
            yield kid, (*up, node)
            yield from walk(kid, (*up, node))


def matches(node, selector):
    a = node["attrs"]
    if selector[0] == "#":
        return a.get("id") == selector[1:]
    if selector[0] == ".":
        return selector[1:] in a.get("class", "").split()
    if selector[0] == "[":
        return a.get("role") == selector[6:-1]
    return node["name"] == selector


def expected(page):
    r = Reader()
    r.feed(page or "")
    r.close()
    everything = list(walk(r.root))
    title = re.search(r"(?is)<title\b[^>]*>(.*?)</title", page or "")
    texts = [(plain(k), up, i) for i, (k, up) in enumerate(everything) if isinstance(k, str) and not any(u["name"] in H.REMOVED for u in up)]
    texts = [x for x in texts if x[0]]
    root, name = r.root, "body"
    for s in H.MAIN:
        first = next((k for k, _ in everything if not isinstance(k, str) and matches(k, s) and k["name"] not in H.VOID), None)
        if first is not None and sum(len(t) + 1 for t, up, _ in texts if any(u is first for u in up)) - 1 >= 120:
            root, name = first, s
            break

    def within(up):
        at = next((i for i, u in enumerate(up) if u is root), None)
        if at is None:
            return None
        below = up[at + 1 :]
        framed = any(u["name"] in H.FRAME or set(u["attrs"].get("class", "").split()) & set(H.FRAME_CLASSES) for u in below)
        return None if framed else below

    order = {id(k): i for i, (k, _) in enumerate(everything)}

    def open_heading(u, at):
        return u["name"] in H.HEADINGS and not ("ended" in u and order[id(u["ended"])] <= at)

    units = {}
    for t, up, at in texts:
        if within(up) is None:
            continue
        outer = next(((i, u) for i, u in enumerate(up) if u["name"] in H.CONTENT and not any(open_heading(v, order[id(u)]) for v in up[:i])), None)
        if outer and any(u is outer[1] for u in within(up)):
            units.setdefault((order[id(outer[1])], False), []).append(t)
        heads = [u for u in up if open_heading(u, at)]
        if heads:
            units.setdefault((order[id(heads[-1])], True), []).append(t)
    sections, at = {}, "Overview"
    for (_, heads), ts in sorted(units.items()):
        t = " ".join(ts)
        if heads:
            at = t[:240]
            sections.setdefault(at, [])
        elif len(t) >= 3 and t[:5000] not in sections.setdefault(at, []):
            sections[at].append(t[:5000])
    return plain(entities.unescape(title.group(1))) if title else "", name, sections


CASES = [
    None,
    "",
    "only text",
    "<p>one<p>two</div></p>three<h2>H</h2>four",
    "<body><header><nav><li>x</header><main><h1>A &amp; B</h1><p>" + "long words " * 20 + "</p><nav><p>gone</p></nav><h2></h2><ul><li>a<ul><li>bcd</ul></ul></main><p>after</p>",
    "<div class='x content'><h2>S</h2><p>" + "abc " * 60 + "</p><h2>T</h2><h2>S</h2><p>again</p></div>",
    "<article>short</article><main><table><tr><td>cell<td>next</table><p>" + "word " * 40,
    "<h2>never closed<p>in it</p><h3>inner</h3><p>outer</p>",
    "<!-- <p>no</p> --><script>if (a < b) '<p>no</p>'</script><p title='a > b'>yes &#233;&#x41;</p><br/><img alt=x>",
    "<form><p>no</p></form><p>yes it is</p></form></form><svg><text>no</text></svg>",
    "<p>" * 300 + "deep" + "</p>" * 200 + "tail",
    "<div role='main' id=\"content\"><p>" + "role " * 50 + "</p><div class=\"breadcrumb a\">home</div>loose</div>",
]


def broken(rng):
    tags = ["p", "li", "h1", "h2", "div", "nav", "main", "article", "span", "a", "form", "br", "td", "footer"]
    out = []
    for _ in range(rng.randrange(5, 120)):
        kind, tag = rng.random(), rng.choice(tags)
        out.append(f"<{tag}>" if kind < 0.35 else f"</{tag}>" if kind < 0.6 else rng.choice(["alpha", "beta gamma ", "x", " ", "delta epsilon zeta eta theta"]))
    return "".join(out)


def test_structure_equals_a_plain_reader(spark):
    rng = random.Random(3)
    pages = CASES + [broken(rng) for _ in range(150)]
    if os.path.exists(PAGES):
        pages += [r.html for r in spark.read.parquet(PAGES).limit(60).collect()]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    got = {r.page_id: r for r in H.page_structure(df).collect()}
    assert len(got) == len(pages)
    for i, page in enumerate(pages):
        title, main, sections = expected(page)
        assert (got[i].title, got[i].main) == (title, main), page
        assert got[i].sections == sections, page


def test_text_and_density(spark):
    df = spark.createDataFrame([(1, "<a>abcd</a>efgh"), (2, ""), (3, "<meta name=Description content='About it'><h2>Head</h2><p>body text</p>"), (4, None)], "page_id long, html string")
    got = {r.page_id: r for r in H.page_structure(df).collect()}
    assert (got[1].text, got[1].link_density) == ("abcd efgh", 0.5)
    assert (got[2].text, got[2].sections, got[2].link_density) == ("", {}, 0.0) == (got[4].text, got[4].sections, got[4].link_density)
    assert (got[3].description, got[3].text) == ("About it", "About it Head body text")


def test_one_exchange(spark):
    df = spark.createDataFrame([(1, "<p>x")], "page_id long, html string")
    plan = H.page_structure(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_references(spark):
    df = spark.createDataFrame([("a&amp;lt; &#65;&#x42; &#0; &#1114112; &unknown; &nbsp;x",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(H.unescaped(F.col("t"))).collect()] == ["a&lt; AB &#0; &#1114112; &unknown;  x", "none", None]
