"""Main text of HTML pages by the maximum-scoring contiguous region.

A page is a sequence of tags and runs of text. Each word scores what words of its kind (the block
they stand in, whether in a link, in boilerplate, in or out of a semantic main element) are worth,
each tag a negative amount; both are log odds counted on labelled pages, those whose markup names
one main element. One linear scan finds the contiguous region with the largest sum. Its text,
without what stands in boilerplate elements, is the result.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadspark.llm.shared import carried, raw_texts, restored, sliced, utf8

#: Labelled pages that the weights are counted on at most, and kinds of words and tags that get weights of
#: their own, the commonest; others have the weights of what nothing is known of.
MAX_LABELLED, MAX_KINDS = 4000, 2000

#: Elements by their part in a page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select", "canvas", "audio", "video", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
BOILERPLATE = {"nav", "footer", "aside", "menu", "button", "dialog", "label", "fieldset", "head"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "status"}
#: Words of class and id names that mark boilerplate.
MARKS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disqus", "footer",
    "form", "gdpr", "header", "legal", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination", "popup", "promo",
    "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar",
    "warning", "widget",
}
#: Those of them that main text is named by as well: no mark within main elements, a weight elsewhere.
WEAK = {"form", "header", "legal", "notice", "notices", "notification", "search", "skip", "warning", "widget"}
#: Those that may well hold more words than the main text.
LONG = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "comment", "comments", "disqus", "promo", "promotion", "replies", "reply", "respond", "sponsor", "sponsored"}
#: First words of names that deny or qualify the rest, and those that make a header the text's own.
QUALIFIERS, TITLED = {"no", "not", "has", "with", "without", "is", "can"}, {"entry", "post", "article", "content"}
#: Elements that an opening tag closes if they are innermost.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^'">]++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_WORD = re.compile(r"[a-z]+")


@dataclass
class Item:
    """A tag, or a run of text (words > 0) with the number of its block."""

    kind: tuple[str, str, str]
    words: int = 0
    text: str = ""
    block: int = 0
    boilerplate: bool = False


@dataclass
class Element:
    """``mark`` is "", "hard" (name, role, hidden), "class" or "weak"; ``began`` holds the number of a
    marked class and the words, all and those of main elements, that stood before it."""

    name: str
    mark: str
    names: frozenset[str] = frozenset()
    began: tuple[int, int, int] = (-1, 0, 0)


def marked_names(value: str) -> set[str]:
    """The words of class and id names that mark boilerplate."""
    out: set[str] = set()
    for name in value.split():
        words = NAME_WORD.findall(name)
        if words and words[0] not in QUALIFIERS:
            out |= MARKS.intersection(words) - ({"header"} if words[0] in TITLED else set())
    return out


def mark_of(name: str, attributes: str, within_main: bool) -> tuple[str, frozenset[str]]:
    """How an element is marked as boilerplate, and the class words that mark it."""
    if name in BOILERPLATE or (name == "header" and not within_main):
        return "hard", frozenset()
    if name in ("html", "body") or (not attributes.strip() and name != "form"):
        return "", frozenset()
    found: set[str] = set()
    if name == "form":  # pages of some frameworks stand in one form as a whole
        return "class", frozenset({"form"})
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return "hard", frozenset()
        if key == "role" and value.strip() in ROLES:
            return "hard", frozenset()
        if key in ("class", "id") and name != "main":
            own = marked_names(value)
            found |= own & {"comment", "comments", "related", "promo", "ad"} if name == "article" else own
    if found <= WEAK:
        return ("weak" if found and not within_main else ""), frozenset(found)
    return "class", frozenset(found)


def items_of(page: str) -> list[Item]:
    """The page's tags and runs of text in order. Never fails: what isn't a tag is text."""
    out, holders = scanned(page, frozenset())
    return scanned(page, holders)[0] if holders else out


def scanned(page: str, unmarked: frozenset[int]) -> tuple[list[Item], frozenset[int]]:
    """The items, and the numbers of the marked elements that hold most of the words in main elements, or of
    all words if there are none (forms: more than stand outside of all marked elements); ``unmarked`` ones
    count as not marked."""
    lower = page.lower()
    main = "article" if "<article" in lower else "main" if "<main" in lower else ""
    out: list[Item] = []
    stack: list[Element] = []
    bad = hard = weak = links = mains = block = at = classes = words = main_words = 0
    held: list[tuple[int, int, int, frozenset[str]]] = []
    free, lone = 0, Counter()  # words outside of all marked elements, and in nothing marked but one form

    def pop(n: int) -> None:
        nonlocal bad, hard, weak, links, mains
        while len(stack) > n:
            e = stack.pop()
            bad -= e.mark in ("hard", "class")
            hard -= e.mark == "hard"
            weak -= e.mark == "weak"
            if e.began[0] >= 0:
                held.append((e.began[0], words - e.began[1], main_words - e.began[2], e.names))
            links -= e.name == "a"
            mains -= e.name == main

    def run(text: str) -> None:
        nonlocal words, main_words, free
        if not text:
            return
        text = references.unescape(text) if "&" in text else text
        place = "" if not main else "in" if mains else "out"
        kind = "boilerplate" if bad else "a" if links else "weak" if weak else next((e.name for e in reversed(stack) if e.name in BLOCK), "")
        n = len(text.split())
        words += n * (not hard)
        main_words += n * (not hard and mains > 0)
        free += n * (not bad)
        if bad == 1 and n and not hard:
            holder = next(e for e in reversed(stack) if e.mark == "class")
            lone[holder.began[0]] += n * (holder.name == "form")
        out.append(Item(("w", kind, place), n, text, block, bad > 0))

    while True:
        m = TAG.search(page, at)
        run(page[at : m.start() if m else len(page)])
        if not m:
            pop(0)
            most = lambda names: 0.9 if names & LONG else 0.5
            return out, frozenset(k for k, n, n_main, names in held if (n_main > 0.5 * main_words if main_words else n > most(names) * words or lone[k] > free))
        at = m.end()
        if m[1]:
            run(m[1])
        if not m[3]:
            continue
        name, closing = m[3].lower(), bool(m[2])
        if name in RAW:
            if not closing and not m[4].rstrip().endswith("/"):
                end = lower.find(f"</{name}", at)
                at = len(page) if end < 0 else end
            continue
        if name in BLOCK:
            block += 1
        elif name == "br":
            out.append(Item(("t", "br", "" if not main else "in" if mains else "out"), 0, " ", block, bad > 0))
            continue
        place = "" if not main else "in" if mains else "out"
        out.append(Item(("t", name, place), block=block, boilerplate=bad > 0))
        if closing:
            deep = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), None)
            if deep is not None:
                pop(deep)
            continue
        if name in VOID or (m[4].rstrip().endswith("/") and name not in BLOCK):
            continue
        if name in BLOCK or name == "a":
            closes = CLOSES.get(name, {"p"} if name in BLOCK else {"a"})
            while stack and stack[-1].name in closes:
                pop(len(stack) - 1)
        mark, names = mark_of(name, m[4], mains > 0)
        if name in BLOCK or name == "a" or mark:
            began = (-1, 0, 0)
            if mark in ("class", "weak"):
                began, mark = (classes, words, main_words), "" if classes in unmarked else mark
                classes += 1
            stack.append(Element(name, mark, names, began))
            bad += mark in ("hard", "class")
            hard += mark == "hard"
            weak += mark == "weak"
            links += name == "a"
            mains += name == main


def settle_links(items: list[Item]) -> list[Item]:
    """Links within running text are text: in blocks that are not mostly links, their words and tags
    take the kind of the rest."""
    words, linked = Counter(), Counter()
    for x in items:
        words[x.block] += x.words
        linked[x.block] += x.words * (x.kind[1] == "a" and x.kind[0] == "w")
    for x in items:
        if x.kind[1] == "a" and not x.boilerplate and 2 * linked[x.block] < words[x.block]:
            x.kind = (x.kind[0], "inline", x.kind[2])
    return items


Weights = dict[tuple[str, str, str], float]

#: What words and tags are worth of which nothing is known, in words.
DEFAULT = {"w": 1.0, "t": -0.3}
FIXED: Weights = {("w", "a", ""): -1.0, ("w", "weak", ""): -1.0}
#: A run of boilerplate is a gap: its text is dropped anyway, however long. None within main elements.
GAP = -6.0


def weigh(counts: dict[tuple[str, str, str], tuple[int, int]]) -> Weights:
    """Log odds of being content, from (inside, outside) counts; tags are worth less than nothing.
    Kinds within and outside of a main element also make up those of pages without one."""
    total = Counter()
    for (kind, name, place), (i, o) in counts.items():
        total[kind, name, place, 0] += i
        total[kind, name, place, 1] += o
        if place:
            total[kind, name, "", 0] += i
            total[kind, name, "", 1] += o
    out: Weights = {}
    for key in {k[:3] for k in total}:
        odds = max(-3.0, min(3.0, math.log((total[(*key, 0)] + 0.5) / (total[(*key, 1)] + 0.5))))
        out[key] = min(-0.05, odds / 2) if key[0] == "t" else min(-0.5, odds) if key[1] == "weak" else odds
    return out


def worth(kind: tuple[str, str, str], weights: Weights) -> float:
    for key in (kind, (kind[0], kind[1], "")):
        if key in weights:
            return weights[key]
        if key in FIXED:
            return FIXED[key]
    return DEFAULT[kind[0]]


def score(x: Item, weights: Weights) -> float:
    if x.boilerplate:
        return GAP if x.words and x.kind[2] != "in" else 0.0
    return worth(x.kind, weights) * (x.words if x.kind[0] == "w" else 1)


def best_region(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous part with the largest positive sum, the first and shortest of
    such; (0, 0) if there is none."""
    best, at = 0.0, (0, 0)
    total, start = 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, at = total, (start, i + 1)
    return at


def main_text(page: str, weights: Weights) -> str:
    """The text of a page's best region, a line for each block."""
    items = settle_links(items_of(page))
    start, end = best_region([score(x, weights) for x in items])
    blocks: dict[int, list[str]] = {x.block: [] for x in items[start:end] if x.words and not x.boilerplate}
    for x in items:  # whole blocks, also where the region begins or ends within one
        if x.text and not x.boilerplate and x.block in blocks:
            blocks[x.block].append(x.text)
    lines = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n".join(x for x in lines if x)


def label_counts(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", most: int = MAX_LABELLED) -> dict[tuple[str, str, str], tuple[int, int]]:
    """(inside, outside) counts of words and tags by kind, on at most ``most`` labelled pages, those
    of the smallest hashes: whole pages with an article or main element. The MAX_KINDS commonest kinds
    are counted (most names of elements are a few; pages can invent others)."""
    pages = pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_html"))
    labelled = pages.where(F.col("_id").isNotNull() & F.lower("_html").rlike("<(article|main)[ >]"))
    ids = labelled.select("_id").orderBy(F.xxhash64("_id"), "_id").limit(most).distinct()
    own = labelled.join(F.broadcast(ids), "_id", "left_semi").select(utf8("_html").alias("_raw"))

    def run(batches):
        for b in sliced(batches):
            inside, outside = Counter(), Counter()
            for raw in b.column(0).to_pylist():
                for x in settle_links(items_of(raw.decode("utf-8", "replace"))):
                    if x.boilerplate:
                        continue
                    to = inside if x.kind[2] == "in" else outside
                    to[x.kind] += x.words if x.kind[0] == "w" else 1
            kinds = sorted(inside.keys() | outside.keys())
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in kinds], pa.string()) for i in range(3)), pa.array([inside[k] for k in kinds], pa.int64()), pa.array([outside[k] for k in kinds], pa.int64())], names=["kind", "name", "place", "inside", "outside"])

    got = own.mapInArrow(run, "kind string, name string, place string, inside long, outside long")
    top = got.groupBy("kind", "name", "place").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).orderBy(F.desc(F.col("i") + F.col("o")), "kind", "name", "place").limit(MAX_KINDS).collect()
    return {(r["kind"], r["name"], r["place"]): (r["i"], r["o"]) for r in top}


def extract(pages: DataFrame, weights: Weights | None = None, id_col: str = "page_id", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all but the html by default) with text and n_chars, a row for each page.

    A null or empty page, and one without words, gives an empty text. Repeated rows are pages each.
    Weights are counted on the pages themselves if none are given; without labelled pages the fixed
    ones hold. One pass, no shuffle. Columns of the input named like the new ones are dropped.
    """
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")] if keep is None else keep
    weights = weigh(label_counts(pages, html_col, id_col)) if weights is None else weights
    own, fields = carried(pages, keep, html_col)
    out = T.StructType([*fields, T.StructField("text", T.StringType())])

    def run(batches):
        for b in sliced(batches):
            texts = [main_text(raw.decode("utf-8", "replace"), weights) for raw in raw_texts(b, keep, html_col)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string())], names=out.names)

    return restored(own.mapInArrow(run, out), keep).withColumn("n_chars", F.length("text").cast("long"))
