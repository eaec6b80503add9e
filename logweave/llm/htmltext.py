"""Main text of web pages by tag-path ratios (operator 1).

A page is cut into blocks (runs of text between block-level tags). Each block
lies on a path of tags from the root. Text length, punctuation and link text
are summed for each path; a path's score is its text per block, times one plus
its punctuation per block, times the square of its share of text outside
links. The scores are smoothed along the page with a Gaussian. The container
is the deepest element that holds most of the score of the page; paragraphs,
headings, lists, tables, quotes and the like belong to the element around them,
and the descent stops at an ``article`` or ``main``. All of the container's
blocks are the main text, but for blocks of links; the threshold, a share of
the page's mean score weighted by text, only decides on whole elements outside
an ``article``, within the container or beside it under the element that holds
the headline, and on paragraphs that stand further out.

Of several ``article`` elements side by side one that holds most of their
score is the article and the others are teasers; articles within it are
comments, if it has text of its own. A section that begins with a heading of
comments goes, and so do blocks that a link goes around (cards) and runs of
links, unless a heading of the article stands right before them (references).

Elements that never hold an article (menus, forms, scripts and so on) and
elements whose class, id or role names such a part are left out beforehand,
with all that is in them. A class or id names one only as a whole, by cue words
and neutral ones; within an article it never takes away a heading or a
paragraph, unless it says advert.

A page is one row, so the job is one narrow pass. Edge cases: a null or empty
page, or one without text, has the empty text; unclosed, misnested or cut off
tags are closed as a browser does; equal pages get equal texts; an empty table
gives an empty table; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from itertools import accumulate, pairwise
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.common import row_of, small_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr output q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEFT_OUT = frozenset("nav footer aside form script style noscript template button select option textarea iframe object svg canvas "
                     "dialog menu title head label fieldset video audio map math noembed noframes xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert toolbar tablist".split())
#: Words of a class or id that name a part beside the article, words that may stand with them, and words for adverts.
ADVERTS = r"ads?|adv|advert\w*|adsense|adslot|sponsor\w*"
CUE = re.compile(
    rf"{ADVERTS}|banners?|promos?|promotions?|promoted|nav|navs|navbar|navigation|menu|menus|menubar|submenu|breadcrumbs?|sidebars?|widgets?|footers?"
    r"|masthead|header|comments?|commentlist|respond|disqus|repl(?:y|ies)|cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|modals?"
    r"|newsletters?|subscribe|subscription|subscriptions|shar(?:e|es|ing)|social|socials|related|recommended|recommendations?|pagination|pager"
    r"|toolbars?|login|signup|copyright|disclaimer|skip|skiplink|hidden|tracking", re.I)
NEUTRAL = re.compile(
    r"main|site|page|web|top|bottom|left|right|upper|lower|first|last|box|boxes|bar|bars|list|lists|item|items|wrap|wrapper|container|block|blocks|section"
    r"|area|zone|slot|unit|panel|inner|outer|links?|btns?|buttons?|icons?|posts?|articles?|stories|content|contents|primary|secondary|global|mobile"
    r"|desktop|user|users|reader|readers|form|thread|js|id|div|col|row|side|sub|up|pop|sign|log|in|out|to|the|and|us|by|on|media|text|message|policy"
    r"|privacy|google|dfp|gpt|fixed|sticky|floating|overlay|x|s|m|l|\d+", re.I)
WORDS = re.compile(r"[^\W\d_]+|\d+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Headings of reader comments, and of lists of links to other articles.
COMMENTS = re.compile(r"\W*(?:\d+\s+)?(?:all |reader |readers' |user |latest )?comments?\W*(?:\d+\W*)?|\W*(?:leave|post|add) a (?:comment|reply)\W*", re.I)
ELSEWHERE = re.compile(r"\W*(?:related|recommended|more (?:from|on|in|like)|read (?:more|next)|you (?:may|might)|most (?:read|popular)|popular|trending|latest"
                       r"|share|follow|tags?|next|previous|up next)\b.*", re.I)
#: An element of the first kind ends an open one of the second when it begins, up to one of the third.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"}), "thead": ({"tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tr", "td", "th"}, {"table"})}
PUNCTUATION = re.compile(r"[.,;:!?、。，！？…]")
SMOOTHING = 1.0
CONTAINER_SHARE = 0.7
THRESHOLD = 0.1
#: A block is one of links if so much of its text, and of its path's, is.
LINK_SHARE = 2 / 3
#: An article holds comments if so much of its score is outside the articles within.
OWN_SHARE = 0.2
#: Parts of an article's text; an element of these is never the container.
PARTS = HEADINGS | frozenset("p ul ol li dl dt dd table caption colgroup thead tbody tfoot tr td th pre blockquote figure figcaption "
                             "address details summary hgroup".split())
ARTICLES = frozenset(("article", "main"))


class Block(NamedTuple):
    path: tuple[str, ...]
    text: str
    linked: int
    #: The numbers of the elements on the path: those of one page are told apart.
    ids: tuple[int, ...] = ()
    #: Whether a link goes around the block.
    card: bool = False


class Open(NamedTuple):
    """An open element; ``out``: it or one around it is left out."""
    tag: str
    out: bool
    inline: bool
    number: int


def names_part(value: str, cue: re.Pattern[str] = CUE) -> bool:
    """Whether a class or id, as a whole, names a part beside the article:
    one of its tokens has a cue word, and neutral words at most beside it."""
    for token in value.split():
        words = WORDS.findall(CAMEL.sub("-", token))
        if any(cue.fullmatch(w) for w in words) and all(CUE.fullmatch(w) or NEUTRAL.fullmatch(w) for w in words):
            return True
    return False


def left_out(tag: str, attributes: str, within: bool) -> bool:
    """Whether the element, by its tag or attributes, is no part of an article;
    ``within``: it stands in an ``article`` or ``main``."""
    if tag in LEFT_OUT:
        return True
    if tag == "header":  # that of the page; an article's own one has its headings
        return not within
    if not attributes.strip() or tag in ("html", "body", "article", "main"):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id"):
            if within and (tag == "p" or tag in HEADINGS or value.lower() == "header"):
                if names_part(value, ADVERT):
                    return True
            elif names_part(value):
                return True
    return False


ADVERT = re.compile(ADVERTS, re.I)


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, without those in left-out elements."""
    out: list[Block] = []
    stack: list[Open] = []  # open block elements, links, and the other inline elements that are left out
    parts: list[str] = []
    links = linked = shut = within = at = number = 0  # open links, linked characters, open inline elements left out, open articles

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not (stack and stack[-1].out):
            raw = entities.unescape(raw)
            parts.append(raw)
            linked += len(raw.strip()) if links else 0

    def flush() -> None:
        nonlocal linked
        if parts:
            whole = " ".join("".join(parts).split())
            if whole:
                open_ = [e for e in stack if not e.inline]
                inner = open_[-1].number if open_ else 0
                card = links > 0 and any(e.tag == "a" and e.number < inner for e in stack)
                out.append(Block(tuple(e.tag for e in open_), whole, linked, tuple(e.number for e in open_), card))
            parts.clear()
        linked = 0

    def begin(tag: str, inline: bool, out_: bool) -> None:
        nonlocal links, shut, within, number
        number += 1
        within += tag in ARTICLES
        stack.append(Open(tag, out_ or (bool(stack) and stack[-1].out), inline, number))
        links += tag == "a"
        shut += inline and tag != "a"

    def end(start: int, stop: int | None = None) -> None:
        nonlocal links, shut, within
        for e in stack[start:stop]:
            within -= e.tag in ARTICLES
            links -= e.tag == "a"
            shut -= e.inline and e.tag != "a"
        del stack[start:stop]

    def place(tag: str) -> int:
        """The innermost open element of this tag, -1 if there is none."""
        return next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), -1)

    while True:
        m = TOKEN.search(page, at)
        text(page[at:m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW and not closing:
            if not attributes.endswith("/") or tag in ("script", "style"):
                close = re.compile(rf"</{tag}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else len(page)
        elif tag == "br" or tag == "wbr":
            if not (stack and stack[-1].out):
                parts.append(" " if tag == "br" else "")
        elif tag in INLINE:
            if closing:
                if (i := place(tag)) >= 0 and stack[i].inline:
                    end(i, i + 1)  # blocks in it may still be open
            elif tag == "a":
                if (i := place("a")) >= 0:
                    end(i, i + 1)  # a link ends where the next begins
                if re.search(r"\bhref\b", attributes, re.I) or shut or left_out(tag, attributes, within > 0):
                    begin(tag, True, left_out(tag, attributes, within > 0))
            elif shut or left_out(tag, attributes, within > 0):
                begin(tag, True, left_out(tag, attributes, within > 0))
        elif tag in VOID:
            if tag == "hr":
                flush()
        elif closing:
            flush()
            if (i := place(tag)) >= 0:
                end(i)
        else:
            flush()
            inner = next((i for i in range(len(stack) - 1, -1, -1) if not stack[i].inline), -1)
            if inner >= 0 and stack[inner].tag == "p":  # a paragraph ends where another block begins
                end(inner)
            ended, upto = ENDS.get(tag, ((), ()))
            for i in range(len(stack) - 1, -1, -1) if ended else ():
                if stack[i].tag in upto:
                    break
                if stack[i].tag in ended:
                    end(i)
                    break
            if tag == "body":  # whatever the head left open
                end(1 if stack and stack[0].tag == "html" else 0)
            begin(tag, False, left_out(tag, attributes, within > 0))
    flush()
    return out


def scores(found: list[Block]) -> list[float]:
    """The smoothed score of each block's path."""
    sums: dict[tuple[str, ...], list[float]] = {}
    for b in found:
        s = sums.setdefault(b.path, [0, 0, 0, 0])
        s[0] += 1
        s[1] += len(b.text)
        s[2] += len(PUNCTUATION.findall(b.text))
        s[3] += min(b.linked, len(b.text))
    path = {p: n_chars / n * (1 + marks / n) * (1 - linked / n_chars) ** 2 for p, (n, n_chars, marks, linked) in sums.items()}
    raw = [path[b.path] for b in found]
    reach = math.ceil(3 * SMOOTHING)
    weight = [math.exp(-0.5 * (d / SMOOTHING) ** 2) for d in range(reach + 1)]
    out = []
    for i in range(len(raw)):
        near = range(max(0, i - reach), min(len(raw), i + reach + 1))
        total = sum(weight[abs(i - j)] for j in near)
        # smoothing lifts a weak path among strong ones, it doesn't sink a strong one
        out.append(max(raw[i], sum(raw[j] * weight[abs(i - j)] for j in near) / total))
    return out


def home(path: tuple[str, ...]) -> tuple[str, ...]:
    """The path of the element that a block's part of the text belongs to."""
    return path[:next((i for i, t in enumerate(path) if t in PARTS), len(path))]


def articles(block: Block) -> tuple[int, ...]:
    """The ``article`` elements around a block, the outermost first."""
    return tuple(n for t, n in zip(block.path, block.ids) if t == "article")


def without_other_articles(found: list[Block]) -> list[Block]:
    """The blocks without teasers beside the article and comments in it."""
    score = scores(found)
    around = [articles(b) for b in found]
    held: dict[int, float] = {}
    own: dict[int, float] = {}
    for b, s, a in zip(found, score, around):
        if a:
            held[a[0]] = held.get(a[0], 0) + s * len(b.text)
            own[a[0]] = own.get(a[0], 0) + s * len(b.text) * (len(a) == 1)
    first = max(held, key=held.__getitem__, default=0)
    alone = bool(held) and held[first] >= CONTAINER_SHARE * sum(held.values())
    return [b for b, a in zip(found, around) if not a or ((a[0] == first or not alone) and (len(a) == 1 or own[a[0]] < OWN_SHARE * held[a[0]]))]


def without_comments(found: list[Block]) -> list[Block]:
    """The blocks without sections that begin with a heading of comments; the
    heading alone goes if its section has text before it."""
    out: list[Block] = []
    ended: tuple[int, ...] | None = None
    for b in found:
        if ended is not None and b.ids[:len(ended)] == ended:
            continue
        ended = None
        at = next((i for i, t in enumerate(b.path) if t in HEADINGS), None)
        if at is not None and COMMENTS.fullmatch(b.text):
            section = b.ids[:at]
            if section and not any(x.ids[:at] == section for x in out):
                ended = section
            continue
        out.append(b)
    return out


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in page order, one a line."""
    found = without_comments(blocks(page or ""))
    found = without_other_articles(found)
    if any(not b.card for b in found):  # (a link that is never closed goes around all)
        found = [b for b in found if not b.card or "h1" in b.path]
    if not found:
        return ""
    score = scores(found)
    mass = [s * len(b.text) for s, b in zip(score, found)]
    total = sum(mass)
    homes = [home(b.path) for b in found]
    depth, inner = 0, list(zip(homes, mass))
    while True:  # one child at most holds most of the score
        held: dict[str, float] = {}
        for h, x in inner:
            if len(h) > depth:
                held[h[depth]] = held.get(h[depth], 0) + x
        child = max(held, key=held.__getitem__, default=None)
        if child is None or held[child] < CONTAINER_SHARE * total:
            break
        inner = [(h, x) for h, x in inner if len(h) > depth and h[depth] == child]
        depth += 1
    container = inner[0][0][:depth]
    container = container[:next((i + 1 for i, t in enumerate(container) if t in ARTICLES), len(container))]
    named = bool(container) and container[-1] in ARTICLES
    depth = len(container)
    inside = [h[:depth] == container for h in homes]
    chars = sum(len(b.text) for b, i in zip(found, inside) if i)
    least = THRESHOLD * sum(x for x, i in zip(mass, inside) if i) / max(1, chars)
    level = [next((t for t in b.path if t in HEADINGS), "") for b in found]

    # the headline: an article's own first of all, otherwise the page's greatest
    around = container
    if any(level) and not (named and any(x for x, i in zip(level, inside) if i)):
        top = min(filter(None, level))
        heads = [h for h, x in zip(homes, level) if x == top]
        while not any(h[:len(around)] == around for h in heads):
            around = around[:-1]

    # link shares: of all paragraphs of a path, of each run of other blocks (a list of links may have the path of one of text)
    runs = list(accumulate((a.path != b.path for a, b in pairwise(found)), initial=0))
    groups = [(b.path, 0 if b.path[-1:] == ("p",) else r) for b, r in zip(found, runs)]
    shares: dict[tuple, list[int]] = {}
    best: dict[tuple[str, ...], float] = {}
    for b, g, h, s in zip(found, groups, homes, score):
        sums = shares.setdefault(g, [0, 0])
        sums[0] += min(b.linked, len(b.text))
        sums[1] += len(b.text)
        best[h] = max(best.get(h, 0), s)

    def of_links(b: Block, g: tuple) -> bool:
        links, n = shares[g]
        return links >= LINK_SHARE * n and b.linked >= LINK_SHARE * len(b.text)

    def kept(b: Block, h: tuple[str, ...], s: float, heading: str, within: bool) -> bool:
        part = b.path != h  # not bare text of an element around the container
        if within or h[:len(around)] == around:
            return bool(heading) or h == container or (h == around and part) or "article" in h or best[h] >= least
        return not named and h == container[:len(h)] and part and s >= least

    out: list[str] = []
    before: Block | None = None  # the heading right before, if the article has one there
    listed: tuple | None = None  # the run of links that it introduces
    for b, g, h, s, x, i in zip(found, groups, homes, score, level, inside):
        if x:
            if not kept(b, h, s, x, i):
                before = None
                continue
            before, listed = b, None
            out.append(b.text)
        elif of_links(b, g):
            if before and i and named:
                if ELSEWHERE.fullmatch(before.text):
                    out.pop()  # a heading of links to elsewhere
                else:
                    listed = g
            before = None
            if listed == g:
                out.append(b.text)
        else:
            before = listed = None
            if kept(b, h, s, x, i):
                out.append(b.text)
    return "\n".join(out)


def extracted(pages: DataFrame, html: str = "html", carry: list[str] | None = None) -> DataFrame:
    """``(page, text, n_chars)``; ``page`` holds the columns ``carry`` (all,
    if None)."""
    small_batches(pages)
    rows = pages.select(row_of(pages if carry is None else pages.select(*carry), "page"), F.col(html).alias("html"))
    schema = T.StructType([rows.schema["page"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=["page", "text", "n_chars"])

    return rows.mapInArrow(extract, schema)
