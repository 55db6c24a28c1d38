"""The structure of HTML pages: title, main content, sections by headings, density of links. Built-in functions alone.

A page is cut into tags and texts by one pattern. A fold over them keeps the stack of open elements, as a lenient reader does:
an end tag closes the innermost open element of its name and all within; one that closes nothing is passed over; what is
never closed runs to the end of what holds it, but a heading ends where another begins. The fold goes by blocks of about the square root of the number of tags, so
that long pages cost little more a tag than short ones. What it yields, a row for each text, is grouped by the page in one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once

# fixed values: elements by what they mean for a text
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
CONTENT = ["p", "li", "td", "th", "dd", "dt"]
REMOVED = ["script", "style", "noscript", "svg", "canvas", "template", "form", "button", "input", "select", "option"]
FRAME = ["nav", "footer", "header"]
FRAME_CLASSES = ["breadcrumb", "breadcrumbs", "social-share"]
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
#: Where the main content is looked for, the first that holds enough: elements, roles, ids (#) and classes (.).
MAIN = ["main", "article", "[role=main]", "#main-content", "#content", ".main-content", ".content", ".page-content", ".field--name-body"]

PIECES = r"(?is)(<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|</?[a-z!?](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<)"
_ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "ndash": "–", "mdash": "—", "middot": "·", "copy": "©", "amp": "&"}


def unescaped(text: Column) -> Column:
    """The text with its numbered and its most usual named references resolved; others stay as they are written."""

    def put(acc: Column, ref: Column) -> Column:
        hexa = F.lower(F.substr(ref, F.lit(3), F.lit(1))) == "x"
        digits = F.regexp_extract(ref, "([0-9a-fA-F]+);?$", 1)
        number = F.when(hexa, F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        known = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        return F.when(known, F.replace(acc, ref, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))).otherwise(acc)

    numbered = F.array_distinct(F.regexp_extract_all(text, F.lit("(&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});)"), F.lit(1)))
    out = F.aggregate(numbered, text, put)
    for name, char in _ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.when(F.contains(text, F.lit("&")), out).otherwise(text)


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, empty without one."""
    found = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1)
    return F.regexp_replace(found, "^[\"']|[\"']$", "")


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def _is(selector: str, name: Column, tag: Column) -> Column:
    if selector.startswith("#"):
        return attribute(tag, "id") == selector[1:]
    if selector.startswith("."):
        return F.array_contains(F.split(attribute(tag, "class"), r"\s+"), selector[1:])
    if selector.startswith("[role="):
        return attribute(tag, "role") == selector[6:-1]
    return name == selector


def _any(cases: Sequence[Column]) -> Column:
    out = cases[0]
    for c in cases[1:]:
        out = out | c
    return out


def _pieces(html: Column, main: Sequence[str]) -> Column:
    """array<struct>: the pieces of a page, with what each tag opens."""

    def told(x: Column) -> Column:
        name = F.lower(F.regexp_extract(x, r"^</?([a-zA-Z][a-zA-Z0-9:-]*)", 1))
        opens = F.startswith(x, F.lit("<")) & ~F.startswith(x, F.lit("</")) & (name != "") & ~name.isin("script", "style")
        kind = F.when(~F.startswith(x, F.lit("<")) | (x == "<"), "text").when(F.startswith(x, F.lit("</")), "end").when(opens & (name.isin(VOID) | F.endswith(x, F.lit("/>"))), "void").when(opens, "start").otherwise("other")
        return once(F.struct(x.alias("x"), name.alias("name"), kind.alias("kind")), marked)

    def marked(p: Column) -> Column:
        start, x, name = p["kind"] == "start", p["x"], p["name"]
        of_class = [F.array_contains(F.split(attribute(x, "class"), r"\s+"), c) for c in FRAME_CLASSES]
        has = F.when(start & F.contains(x, F.lit("=")), F.array(*[_is(s, name, x) for s in main])).when(start, F.array(*[F.lit(False) if s[0] in "#.[" else name == s for s in main]))
        frame = start & (name.isin(FRAME) | (F.contains(x, F.lit("=")) & _any(of_class)))
        return F.struct(p["kind"].alias("kind"), name.alias("name"), F.when(p["kind"] == "text", x).alias("text"), F.coalesce(has, F.array(*[F.lit(False)] * len(main))).alias("main"), F.coalesce(frame, F.lit(False)).alias("frame"))

    return F.transform(F.regexp_extract_all(html, F.lit(PIECES), F.lit(1)), told)


_STATE = "struct<stack:array<string>,at:int,removed:int,block:int,block_at:int,heading:int,heading_at:int,anchor:int,main:array<int>,frame:array<int>,seen:array<int>>"

_FIELDS = [f.split(":")[0] for f in _STATE[len("struct<") : -1].split(",")]


def _texts(html: Column, main: Sequence[str]) -> Column:
    """array<struct>: each text of a page with the elements that it stands in."""
    n = len(main)
    text_type = "struct<at:int,text:string,block:int,block_depth:int,heading:int,anchor:boolean,main:array<int>,frame:array<int>>"
    start = F.struct(F.array().cast("array<string>"), *[F.lit(0)] * 7, F.array_repeat(F.lit(0), n), F.array_repeat(F.lit(0), n + 1), F.array_repeat(F.lit(0), n)).cast(_STATE)

    def step(acc: Column, p: Column) -> Column:
        s = acc["s"]
        back = F.array_position(F.reverse(s["stack"]), p["name"])
        closed = F.when(back > 0, F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - back.cast("int"))).otherwise(s["stack"])
        stack = F.when(p["kind"] == "start", F.array_append(s["stack"], p["name"])).when(p["kind"] == "end", closed).otherwise(s["stack"])
        moved = once(F.struct(s.alias("s"), stack.alias("stack"), F.size(stack).alias("d"), p.alias("p")), enter)
        emit = F.struct(s["at"], p["text"], s["block_at"], s["block"], s["heading_at"], s["anchor"] > 0, s["main"], s["frame"]).cast(text_type)
        out = F.when((p["kind"] == "text") & (s["removed"] == 0) & (F.trim(F.regexp_replace(p["text"], r"\s+", " ")) != ""), F.array_append(acc["out"], emit)).otherwise(acc["out"])
        # texts, comments and void tags open and close nothing
        tag = p["kind"].isin("start", "end")
        return F.struct(F.when(tag, moved).otherwise(F.struct(*[(s[f] + 1 if f == "at" else s[f]).alias(f) for f in _FIELDS])).alias("s"), out.alias("out"))

    def enter(m: Column) -> Column:
        s, p, d, started = m["s"], m["p"], m["d"], m["p"]["kind"] == "start"

        def kept(depth: Column) -> Column:
            return F.when(depth > d, 0).otherwise(depth)

        def opened(field: str, case: Column) -> Column:
            own = kept(s[field])
            return F.when((own == 0) & started & case, d).otherwise(own)

        heads = started & p["name"].isin(HEADINGS)
        block = opened("block", p["name"].isin(CONTENT) & (kept(s["heading"]) == 0))
        block_at = F.when(block == 0, 0).when((kept(s["block"]) == 0), s["at"] + 1).otherwise(s["block_at"])
        # a heading ends where another begins
        heading = F.when(heads, d).otherwise(kept(s["heading"]))
        heading_at = F.when(heads, s["at"] + 1).when(heading == 0, 0).otherwise(s["heading_at"])
        mains = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when((s["seen"][i] == 0) & p["main"][i], d).otherwise(kept(s["main"][i])))
        seen = F.zip_with(s["seen"], p["main"], lambda a, b: F.when(b, 1).otherwise(a))
        # the frame within each main element, and within the whole page
        frames = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.when((kept(s["frame"][i]) == 0) & p["frame"] & ((i == n) | (kept(F.get(s["main"], i)) > 0)), d).otherwise(kept(s["frame"][i])))
        return F.struct(
            m["stack"], s["at"] + 1, opened("removed", p["name"].isin(REMOVED)), block, block_at, heading, heading_at, opened("anchor", p["name"] == "a"), mains, frames, seen
        ).cast(_STATE)

    def folded(pieces: Column) -> Column:
        width = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(pieces).cast("double"))).cast("int"))
        empty = F.array().cast(f"array<{text_type}>")
        blocks = F.transform(F.sequence(F.lit(0), (F.size(pieces) / width).cast("int")), lambda i: F.slice(pieces, i * width + 1, width))
        run = F.aggregate(
            blocks,
            F.struct(start.alias("s"), empty.alias("out")),
            lambda acc, part: once(
                F.struct(F.aggregate(part, F.struct(acc["s"].alias("s"), empty.alias("out")), step).alias("own"), acc["out"].alias("out")),
                lambda r: F.struct(r["own"]["s"].alias("s"), F.concat(r["out"], r["own"]["out"]).alias("out")),
            ),
        )
        return run["out"]

    return once(_pieces(F.coalesce(html, F.lit("")), main), folded)


def page_structure(pages: DataFrame, ident: str = "page_id", html: str = "html", main: Sequence[str] = tuple(MAIN), least: int = 120) -> DataFrame:
    """(ident, title, description, main, sections, text, n_chars, link_density): the parts of each page.

    main is the first of `main` whose first element holds at least `least` characters, else "body", the whole page. Within
    it, without navigation and frames: sections maps each heading (the first 240 characters) to the distinct texts (of 3
    characters at least, 5000 at most) of outermost content elements after it; those before any heading are under "Overview",
    a heading without content has an empty array. text is the description, headings and texts in order, or the main
    element's plain text where there are no sections. n_chars counts the characters of main's texts, link_density is the share of them that stand in links.
    Pages without HTML have empty parts. ident tells pages apart.
    """
    html_ = F.coalesce(F.col(html), F.lit(""))
    meta = F.filter(F.regexp_extract_all(html_, F.lit("(?is)(<meta\\b[^>]*>)"), F.lit(1)), lambda t: F.lower(attribute(t, "name")) == "description")
    title = _plain(unescaped(F.regexp_extract(html_, r"(?is)<title\b[^>]*>(.*?)</title", 1)))
    heads = pages.select(F.col(ident), title.alias("__title"), _plain(unescaped(attribute(F.coalesce(F.get(meta, F.lit(0)), F.lit("")), "content"))).alias("__about"), _texts(html_, main).alias("__t"))

    # which main element: characters of the texts of each, with one space between them
    sized = F.transform(F.col("__t"), lambda t: F.struct(F.length(_plain(unescaped(t["text"]))).alias("n"), t["main"].alias("main")))
    lengths = F.aggregate(sized, F.array_repeat(F.lit(-1), len(main)), lambda acc, t: F.zip_with(acc, t["main"], lambda a, m: F.when(m > 0, a + 1 + t["n"]).otherwise(a)))
    first = F.array_position(F.transform(lengths, lambda x: x >= least), True).cast("int")
    chosen = heads.select(ident, "__title", "__about", "__t", first.alias("__k"))
    root = F.when(F.col("__k") > 0, F.get(F.array(*[F.lit(m) for m in main]), F.col("__k") - 1)).otherwise("body")

    k, keys = F.col("__k"), [ident, "title", "description", "main"]
    depth = F.when(k > 0, F.get("x.main", k - 1)).otherwise(F.lit(-1))
    frame = F.when(k > 0, F.get("x.frame", k - 1)).otherwise(F.get("x.frame", F.lit(len(main))))
    rows = chosen.repartition(F.col(ident)).select(ident, F.col("__title").alias("title"), F.col("__about").alias("description"), root.alias("main"), "__k", F.explode_outer("__t").alias("x"))
    own = F.coalesce((depth != 0) & (frame == 0), F.lit(False))
    rows = rows.select(*keys, "x", own.alias("own"), depth.alias("depth"), _plain(unescaped(F.col("x.text"))).alias("t"))
    # a text belongs to its outermost content element and to its heading, or to none (unit 0)
    block = F.when(F.col("own") & (F.col("x.block") > 0) & (F.col("x.block_depth") > F.col("depth")), F.col("x.block"))
    heading = F.when(F.col("own") & (F.col("x.heading") > 0), F.col("x.heading"))
    units = F.filter(F.array(F.struct(block.alias("at"), F.lit(False).alias("heads")), F.struct(heading.alias("at"), F.lit(True).alias("heads"))), lambda u: u["at"].isNotNull())
    units = F.when(F.size(units) > 0, units).otherwise(F.array(F.struct(F.lit(0).alias("at"), F.lit(False).alias("heads"))))
    parts = rows.select(*keys, "own", F.struct(F.col("x.at").alias("at"), "t", F.col("x.anchor").alias("linked")).alias("p"), F.posexplode(units).alias("i", "u"))
    # one row a unit, its texts in order; then the heading before it is carried along the page
    said = F.array_join(F.filter(F.array_sort(F.collect_list(F.when(F.col("own"), F.col("p"))))["t"], lambda t: t != ""), " ")
    by_unit = parts.groupBy(*keys, F.col("u.at").alias("at"), F.col("u.heads").alias("heads")).agg(_plain(said).alias("t"), F.collect_list(F.when(F.col("own") & (F.col("i") == 0), F.col("p"))).alias("ps"))
    along = Window.partitionBy(*keys).orderBy("at")
    named = F.when(F.col("heads") & (F.col("t") != ""), F.substring("t", 1, 240))
    told = by_unit.withColumns({"name": F.coalesce(F.last(named, True).over(along), F.lit("Overview")), "named": named})
    value = F.when(~F.col("heads") & (F.col("at") > 0) & (F.length("t") >= 3), F.struct("at", "t"))
    since = F.min(F.when(F.col("named").isNotNull() | value.isNotNull(), F.col("at")))
    by_name = told.groupBy(*keys, "name").agg(since.alias("at"), F.array_sort(F.collect_list(value)).alias("v"), F.flatten(F.collect_list("ps")).alias("ps"))
    section = F.when(F.col("at").isNotNull(), F.struct("at", "name", F.transform(F.array_distinct(F.col("v")["t"]), lambda t: F.substring(t, 1, 5000)).alias("v")))
    done = by_name.groupBy(*keys).agg(F.array_sort(F.collect_list(section)).alias("ss"), F.array_sort(F.flatten(F.collect_list("ps"))).alias("ps"))
    spoken = F.flatten(F.transform("ss", lambda s: F.concat(F.when(s["name"] == "Overview", F.array().cast("array<string>")).otherwise(F.array(s["name"])), s["v"])))
    text = F.array_join(F.filter(F.concat(F.array("description"), spoken), lambda t: t != ""), " ")
    length = lambda ps: F.aggregate(ps, F.lit(0), lambda acc, p: acc + F.length(p["t"]))
    return done.select(
        *keys,
        F.map_from_arrays(F.col("ss")["name"], F.col("ss")["v"]).alias("sections"),
        F.when(text != "", text).otherwise(F.array_join(F.filter(F.col("ps")["t"], lambda t: t != ""), " ")).alias("text"),
        length(F.col("ps")).alias("n_chars"),
        F.coalesce(F.try_divide(length(F.filter("ps", lambda p: p["linked"])), length(F.col("ps"))), F.lit(0.0)).alias("link_density"),
    )
