"""Main text of web pages by union-free wrapper inference per host (operator 2).

A page becomes a stream of tags and text. Runs of equal groups are folded into repeated groups; then the folded stream is
aligned with the host's wrapper so far: what only one side has becomes optional, texts that differ become slots, texts that
agree on every page stay fixed. Wrappers of parts of a host are aligned with each other in the same way, so every task folds
its own pages and only wrappers are shuffled. A wrapper's slots are main text if they lie in the article (or main) element
where the host has one, and in no menu, header, footer, sidebar, notice, advert, form or comment section; fixed texts beside
changing ones that repeat on all of several pages are template text. A page is read by aligning it with its host's wrapper.

Null and empty pages, and pages without main text, give the empty text. Null urls are one host. Unclosed tags end with the
element around them. Pages of any length are read whole. Repeated rows give the same text each. An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from operator import add

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import cut_lineage, ship_package, table
from quayside.llm.registry import register

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|svg|iframe|object|math|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|$)|</?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|<[!?][^>]*>|[^<]+|<", re.S | re.I)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
ROLE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "param", "track"}
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "td", "th", "tr", "table", "tbody", "thead", "blockquote", "pre", "section", "article", "main", "figure", "figcaption", "hr", "body", "header", "footer", "nav", "aside", "form", "fieldset", "address", "details", "summary", "caption", "center"}
ASIDE_TAGS = {"nav", "header", "footer", "aside", "form", "button", "head", "dialog", "menu", "label"}
ASIDE_NAMES = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|side|footer\w*|header|masthead|notice\w*|cookie\w*|consent|popup|modal|comment\w*|replies|disqus|share|sharing|social|related|newsletter|subscribe|pagination|pager|widget\w*|login|search)(?:$|[\s_-])", re.I)
MAIN_TAGS = {"article", "main"}
TEXT = "#"


def tokens(html: str) -> list[tuple[str, str]]:
    """(kind, text): kind is '#' for text, else the tag with its names, such as 'div.ad' or '/p'."""
    out = []
    for m in TOKEN.finditer(html):
        raw = m[0]
        if m[1] or raw.startswith(("<!", "<?")):
            continue
        name = NAME.match(raw)
        if not name:
            if raw.strip() or (out and out[-1][0] == TEXT):
                if out and out[-1][0] == TEXT:
                    out[-1] = (TEXT, out[-1][1] + raw)
                else:
                    out.append((TEXT, raw))
            continue
        tag = name[1].lower()
        if raw[1] == "/":
            out.append(("/" + tag, ""))
        else:
            names = " ".join(a or b or c for a, b, c in ROLE.findall(raw)) if "=" in raw else ""
            out.append((tag + ("." + names if names else ""), ""))
    return out


# A wrapper is a list of nodes: ["t", tag], ["#", text or None, pages it was seen on], ["+", nodes], ["?", nodes].


def shape(node: list) -> str:
    """What two nodes must share to be aligned."""
    if node[0] == "t":
        return node[1]
    if node[0] == TEXT:
        return TEXT
    return "(" + " ".join(shape(n) for n in node[1]) + ")"


def same_text(a, b):
    return a if a == b else None


def fold(nodes: list, join=same_text, longest: int = 6) -> list:
    """Fold runs of two or more equal groups into repeated groups, short groups first."""
    for width in range(1, longest + 1):
        shapes = [shape(n) for n in nodes]
        out, i = [], 0
        while i < len(nodes):
            times = 1
            while shapes[i : i + width] == shapes[i + times * width : i + (times + 1) * width] and i + (times + 1) * width <= len(nodes):
                times += 1
            if times > 1:
                group = nodes[i : i + width]
                for k in range(1, times):
                    group = [joined(a, b, join) for a, b in zip(group, nodes[i + k * width : i + (k + 1) * width])]
                out.append(group[0] if width == 1 and group[0][0] == "+" else ["+", group])
                i += times * width
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def joined(a: list, b: list, join=same_text, seen=max) -> list:
    """One node for two of the same shape; ``join`` makes one text of two, ``seen`` one count of pages."""
    if a[0] == TEXT:
        return [TEXT, join(a[1], b[1]), seen(a[2], b[2])]
    if a[0] == "t":
        return a
    return ["+" if "+" in (a[0], b[0]) else "?", [joined(x, y, join, seen) for x, y in zip(a[1], b[1])]]


def page_nodes(html: str | None) -> list:
    return fold([[TEXT, text.strip(), 1] if kind == TEXT else ["t", kind] for kind, text in tokens(html or "")])


def optional(nodes: list) -> list:
    return [n if n[0] == "?" else ["?", [n]] for n in nodes]


def align(a: list, b: list) -> list:
    """The wrapper of what two wrappers stand for."""
    bare_a, bare_b = ([n[1][0] if n[0] == "?" else n for n in side] for side in (a, b))
    shapes_a, shapes_b = ([shape(["+", [n]]) if n[0] != "+" else shape(n) for n in side] for side in (bare_a, bare_b))
    if shapes_a == shapes_b:
        blocks = [("equal", 0, len(a), 0, len(b))]
    else:
        blocks = SequenceMatcher(None, shapes_a, shapes_b, autojunk=False).get_opcodes()
    out = []
    for kind, i, j, k, m in blocks:
        if kind == "equal":
            for x, y, bare_x, bare_y in zip(a[i:j], b[k:m], bare_a[i:j], bare_b[k:m]):
                if shape(bare_x) == shape(bare_y):
                    node = joined(bare_x, bare_y, seen=add)
                else:  # one side is a single group, the other a repeated one
                    one, many = (bare_x, bare_y) if bare_y[0] == "+" else (bare_y, bare_x)
                    node = ["+", [joined(one, many[1][0], seen=add)]] if many[0] == "+" else one
                out.append(["?", [node]] if "?" in (x[0], y[0]) else node)
        else:
            out += optional(a[i:j]) + optional(b[k:m])
    return out


def roles(wrapper: list) -> list[bool]:
    """For every text of the wrapper in order: is it main text?"""
    found: list[tuple[bool, bool, bool]] = []  # aside, in article, fixed
    stack: list[tuple[str, bool, bool]] = []

    def walk(nodes: list) -> None:
        for node in nodes:
            if node[0] == "t":
                tag, _, names = node[1].partition(".")
                if tag.startswith("/"):
                    at = max((i for i, s in enumerate(stack) if s[0] == tag[1:]), default=-1)
                    if at >= 0:
                        del stack[at:]
                elif tag not in VOID:
                    stack.append((tag, tag in ASIDE_TAGS or bool(ASIDE_NAMES.search(names)), tag in MAIN_TAGS))
            elif node[0] == TEXT:
                found.append((any(s[1] for s in stack), any(s[2] for s in stack), node[1] is not None and node[2] >= 5))
            else:
                walk(node[1])

    walk(wrapper)
    article = any(inside and not aside for aside, inside, _ in found)
    main = [not aside and (inside or not article) for aside, inside, _ in found]
    changing = sum(m and not f[2] for m, f in zip(main, found))
    if changing >= 2:
        main = [m and not f[2] for m, f in zip(main, found)]
    return main


def flat(nodes: list) -> Iterator[list]:
    for node in nodes:
        if node[0] in "?+":
            yield from flat(node[1])
        else:
            yield node


def slots(page: list, wrapper: list, main: list[bool]) -> list[bool | None]:
    """For every text of a folded page: the role of the wrapper's text it is aligned with; None where there is none."""
    a, b = list(flat(page)), list(flat(wrapper))
    numbers, n = [], 0
    for node in b:
        numbers.append(n)
        n += node[0] == TEXT
    out: list[bool | None] = [None] * len(a)
    shapes_a, shapes_b = [shape(x) for x in a], [shape(x) for x in b]
    if shapes_a == shapes_b:
        pairs = zip(range(len(a)), range(len(b)))
    else:
        pairs = ((i + d, k + d) for i, k, size in SequenceMatcher(None, shapes_a, shapes_b, autojunk=False).get_matching_blocks() for d in range(size))
    for i, k in pairs:
        if a[i][0] == TEXT:
            out[i] = main[numbers[k]]
    return [o for o, node in zip(out, a) if node[0] == TEXT]


def extract(html: str | None, wrapper: list | None, main: list[bool], kept: dict) -> str:
    if not html:
        return ""
    stream = tokens(html)
    kinds = tuple(k for k, _ in stream)
    if kinds not in kept:
        numbers = iter(range(len(kinds)))
        folded = fold([[TEXT, [next(numbers)], 1] if k == TEXT else ["t", k] for k in kinds], lambda a, b: a + b)  # a text knows its places
        own = roles(folded)
        by_wrapper = slots(folded, wrapper, main) if wrapper else [None] * len(own)
        labels = [False] * kinds.count(TEXT)
        for node, o, w in zip((n for n in flat(folded) if n[0] == TEXT), own, by_wrapper):
            for place in node[1]:
                labels[place] = o if w is None else o and w
        kept[kinds] = labels
        if len(kept) > 5_000:
            kept.clear()
            kept[kinds] = labels
    labels = iter(kept[kinds])
    blocks, parts = [], []

    def flush() -> None:
        line = " ".join(entities.unescape("".join(parts)).split())
        if line:
            blocks.append(line)
        parts.clear()

    for kind, text in stream:
        if kind == TEXT:
            if next(labels, False):
                parts.append(text)
        else:
            tag = kind.lstrip("/").partition(".")[0]
            if tag in BLOCKS:
                flush()
            elif tag == "br":
                parts.append(" ")
    flush()
    return "\n".join(blocks)


def merge(a: tuple[int, list] | None, pages: int, nodes: list) -> tuple[int, list]:
    return (pages, nodes) if a is None else (a[0] + pages, align(a[1], nodes))


def infer_wrappers(pages: DataFrame, host: str = "host", parts: int = 64) -> DataFrame:
    """host, pages, wrapper (JSON). Each task folds its own pages; wrappers of a host meet in two steps."""
    ship_package(pages.sparkSession)

    def fold_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, tuple[int, list]] = {}
        for batch in batches:
            for name, html in zip(batch["host"], batch["html"]):
                if html:
                    found[name] = merge(found.get(name), 1, page_nodes(html))
        yield pd.DataFrame([(h, n, json.dumps(w)) for h, (n, w) in sorted(found.items())], columns=["host", "pages", "wrapper"])

    def fold_wrappers(group: pd.DataFrame) -> pd.DataFrame:
        found = None
        for n, w in sorted(zip(group["pages"], group["wrapper"]), key=lambda x: (-x[0], x[1])):
            found = merge(found, int(n), json.loads(w))
        return pd.DataFrame({"host": [group["host"].iat[0]], "pages": [found[0]], "wrapper": [json.dumps(found[1])]})

    schema = "host string, pages long, wrapper string"
    partial = pages.select(F.col(host).alias("host"), "html").mapInPandas(fold_pages, schema)
    partial = partial.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(parts)).alias("part")).applyInPandas(fold_wrappers, schema)
    return partial.groupBy("host").applyInPandas(fold_wrappers, schema)


def with_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every row."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[^/]*//([^/?#]*)", 1)), F.lit(""))
    hosted = pages.select("page_id", "url", "html", host.alias("host"))
    wrappers = cut_lineage(infer_wrappers(hosted), "wrappers")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple] = {}
        for batch in batches:
            out = []
            for name, html, raw in zip(batch["host"], batch["html"], batch["wrapper"]):
                if name not in known:
                    if len(known) > 200:
                        known.clear()
                    wrapper = json.loads(raw) if isinstance(raw, str) else None
                    known[name] = (wrapper, roles(wrapper) if wrapper else [], {})
                out.append(extract(html, *known[name]))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": out})

    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string"
    return hosted.join(wrappers, "host", "left").select("page_id", "url", "html", "host", "wrapper").mapInPandas(read, schema)


@register("op2_main_text")
def op2_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return with_main_text(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))
