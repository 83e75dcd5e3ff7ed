"""Main text of web pages: flat blocks judged by a decision tree over their own and their neighbours' features.

A page becomes a flat list of text blocks. A block is known by its number of words and of links, the
share of its words that are in links, the same of the blocks before and after, and by what its markup
and its wording say of it. What is main text is decided by a tree grown on a small table of labelled
pages, where neither markup nor density alone says which blocks are the article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is never text: scripts, styles, media and form controls (fixed values).
RAW = ("script", "style", "noscript", "template", "iframe", "title", "svg", "canvas", "audio", "video", "textarea", "select", "button")
#: Elements that end a block where they start and where they end (fixed values).
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that can hold others and say what they hold (fixed values).
CONTAINERS = frozenset("article aside blockquote details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
#: Elements that hold something other than the article (fixed values).
ASIDE = frozenset("nav footer aside dialog menu form".split())
#: Words of class, id and role that say the same of any container, and those that say it only names a page's layout (fixed values).
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disclaimer footer "
    "header masthead menu modal nav navbar navigation newsletter notice popup promo related reply respond share sharing sidebar social sponsor sponsored "
    "subscribe toolbar widget complementary alert".split()
)
LAYOUT_NAMES = frozenset("has no with without layout".split())
ARTICLE_NAMES = frozenset("article main".split())
#: How a block begins that is a notice rather than text, and headings after which readers speak (fixed values).
NOTICE = re.compile(r"(?:\u00a9|\(c\) |copyright |all rights reserved|we use cookies|this (?:web)?site uses cookies|advertisement\b|sponsored\b|subscribe (?:to|now)\b|sign up (?:to|for)\b|share (?:this|on)\b)", re.I)
COMMENTS = re.compile(r"\W*(?:\d+\s+)?(?:reader |user )?(?:comments?|responses|leave a (?:reply|comment)|join the (?:discussion|conversation)|kommentare|commentaires|comentarios)\W*(?:\(?\d+\)?)?\W*", re.I)

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?:.*?</(?P=raw)\b[^>]*+(?:>|\Z)|.*\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/a-zA-Z][^>]*+(?:>|\Z)"
    r"|(?P<text>[^<]++|<)",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


class Block(NamedTuple):
    """words, and those of them that are in links; links; whether it is a heading; whether it is inside an article, and inside
    something that isn't one by its markup; whether it begins like a notice; and whether a heading of comments is before it."""

    words: int
    linked: int
    links: int
    heading: int
    article: int
    aside: int
    notice: int
    closed: int


def _marked(tag: str, attrs: str, article: int, aside: int) -> tuple[int, int]:
    """(article, aside) of what an element holds."""
    names = {w for m in NAMES.finditer(attrs) for w in re.split(r"[\s_-]+", (m[1] or m[2] or m[3] or "").lower())} if attrs else set()
    if tag in ASIDE or (tag == "header" and not article) or (attrs and HIDDEN.search(attrs)):
        aside = 1
    elif names & ASIDE_NAMES and not names & LAYOUT_NAMES and not (tag == "header" and article):
        aside = 1
    if tag in ("article", "main") or names & ARTICLE_NAMES:
        article = 1
    return article, aside


def blocks(page: str | None) -> tuple[list[str], list[Block]]:
    """The page's text blocks in order, white space made single and character references decoded, and what is known of
    each. A link goes on over the blocks inside it."""
    texts: list[str] = []
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = [("", 0, 0)]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []
    heading = link = links = closed = 0

    def flush() -> None:
        nonlocal links, closed
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            words = len(text.split())
            if words <= 6 and COMMENTS.fullmatch(text):
                closed = 1
            _, article, aside = stack[-1]
            texts.append(text)
            out.append(Block(words, len(html.unescape("".join(linked)).split()), links, heading, article, aside, int(bool(NOTICE.match(text))), closed))
        parts.clear(), linked.clear()
        links = link

    for m in TOKEN.finditer(page or ""):
        if (text := m["text"]) is not None:
            parts.append(text)
            if link:
                linked.append(text)
        elif (tag := m["tag"]) is not None:
            tag = tag.lower()
            ends = bool(m["end"])
            if tag == "a":
                link = 0 if ends else 1
                links += link
                linked.append(" ")
            elif tag == "br":
                parts.append(" ")
                linked.append(" ")
            elif tag in BLOCKS:
                flush()
                heading = int(tag in ("h1", "h2", "h3", "h4", "h5", "h6") and not ends)
                if tag in CONTAINERS:
                    if not ends:
                        if not m["attrs"].endswith("/"):
                            stack.append((tag, *_marked(tag, m["attrs"], *stack[-1][1:])))
                            opened[tag] += 1
                    elif opened[tag]:
                        while (gone := stack.pop()[0]) != tag:
                            opened[gone] -= 1
                        opened[tag] -= 1
        elif m["raw"] is not None:
            parts.append(" ")
    flush()
    return texts, out


FEATURES = ("words", "density", "links", "words_before", "density_before", "words_after", "density_after", "heading", "article", "aside", "notice", "closed")


def features(found: list[Block]) -> list[tuple]:
    """Of each block, in the order of FEATURES; beyond the page's ends there are 0 words."""
    sizes = [(0, 0.0), *((b.words, b.linked / b.words) for b in found), (0, 0.0)]
    return [(*sizes[k + 1], b.links, *sizes[k], *sizes[k + 2], *b[3:]) for k, b in enumerate(found)]


#: Labelled pages: each block is words, linked words, links, heading, article, aside, notice, closed, and 1 for main text.
LABELLED = (
    # a news page: menu, site header, article with a linked word, a share bar and a related list inside it, footer
    ((1, 1, 1, 0, 0, 1, 0, 0, 0), (1, 1, 1, 0, 0, 1, 0, 0, 0), (2, 2, 1, 0, 0, 1, 0, 0, 0), (8, 0, 0, 0, 0, 1, 0, 0, 0), (9, 0, 0, 1, 1, 0, 0, 0, 1), (62, 0, 0, 0, 1, 0, 0, 0, 1), (110, 4, 1, 0, 1, 0, 0, 0, 1),
     (3, 0, 0, 0, 1, 0, 0, 0, 1), (2, 2, 2, 0, 1, 0, 0, 0, 0), (75, 0, 0, 0, 1, 0, 0, 0, 1), (2, 0, 0, 1, 1, 0, 0, 0, 0), (7, 7, 1, 0, 1, 0, 0, 0, 0), (9, 9, 1, 0, 1, 0, 0, 0, 0), (6, 6, 1, 0, 1, 0, 0, 0, 0), (14, 0, 0, 0, 0, 1, 1, 0, 0)),
    # an article of short paragraphs, with a paragraph that is one link between prose, a list of its own, and an advert
    ((1, 1, 1, 0, 0, 1, 0, 0, 0), (1, 1, 1, 0, 0, 1, 0, 0, 0), (12, 0, 0, 0, 0, 1, 0, 0, 0), (6, 0, 0, 1, 1, 0, 0, 0, 1), (1, 0, 0, 0, 1, 0, 0, 0, 1), (20, 0, 0, 0, 1, 0, 0, 0, 1), (5, 5, 1, 0, 1, 0, 0, 0, 1),
     (33, 0, 0, 0, 1, 0, 0, 0, 1), (4, 0, 0, 0, 1, 0, 0, 0, 1), (5, 2, 1, 0, 1, 0, 0, 0, 1), (3, 0, 0, 0, 1, 0, 0, 0, 1), (11, 0, 0, 0, 1, 1, 0, 0, 0), (2, 0, 0, 0, 1, 0, 0, 0, 1), (9, 0, 0, 0, 0, 1, 1, 0, 0)),
    # a page without article elements: links, prose, a box of links, prose, links and an owner's line
    ((1, 1, 1, 0, 0, 0, 0, 0, 0), (2, 2, 1, 0, 0, 0, 0, 0, 0), (1, 1, 1, 0, 0, 0, 0, 0, 0), (7, 0, 0, 1, 0, 0, 0, 0, 1), (80, 0, 0, 0, 0, 0, 0, 0, 1), (45, 3, 1, 0, 0, 0, 0, 0, 1), (6, 6, 3, 0, 0, 0, 0, 0, 0),
     (120, 0, 0, 0, 0, 0, 0, 0, 1), (18, 0, 0, 0, 0, 0, 0, 0, 1), (52, 5, 2, 0, 0, 0, 0, 0, 1), (2, 2, 1, 0, 0, 0, 0, 0, 0), (3, 3, 1, 0, 0, 0, 0, 0, 0), (8, 0, 0, 0, 0, 0, 1, 0, 0)),
    # the same with cards: linked titles with teasers, which are links as well, and a heading above them
    ((1, 1, 1, 0, 0, 0, 0, 0, 0), (1, 1, 1, 0, 0, 0, 0, 0, 0), (10, 0, 0, 1, 0, 0, 0, 0, 1), (95, 0, 0, 0, 0, 0, 0, 0, 1), (70, 6, 2, 0, 0, 0, 0, 0, 1), (2, 0, 0, 1, 0, 0, 0, 0, 0), (6, 6, 1, 1, 0, 0, 0, 0, 0),
     (18, 18, 1, 0, 0, 0, 0, 0, 0), (7, 7, 1, 1, 0, 0, 0, 0, 0), (22, 22, 1, 0, 0, 0, 0, 0, 0), (5, 5, 5, 0, 0, 0, 0, 0, 0)),
    # cards inside an article element
    ((2, 2, 1, 0, 0, 1, 0, 0, 0), (8, 0, 0, 1, 1, 0, 0, 0, 1), (40, 0, 0, 0, 1, 0, 0, 0, 1), (66, 2, 1, 0, 1, 0, 0, 0, 1), (3, 0, 0, 1, 1, 0, 0, 0, 0), (5, 5, 1, 1, 1, 0, 0, 0, 0), (16, 16, 1, 0, 1, 0, 0, 0, 0), (6, 6, 1, 1, 1, 0, 0, 0, 0), (21, 21, 1, 0, 1, 0, 0, 0, 0)),
    # readers' comments under a heading, without names that say so, inside and outside an article
    ((1, 1, 1, 0, 0, 1, 0, 0, 0), (7, 0, 0, 1, 1, 0, 0, 0, 1), (90, 0, 0, 0, 1, 0, 0, 0, 1), (55, 0, 0, 0, 1, 0, 0, 0, 1), (1, 0, 0, 1, 1, 0, 0, 1, 0), (25, 0, 0, 0, 1, 0, 0, 1, 0), (4, 0, 0, 0, 1, 0, 0, 1, 0), (60, 0, 0, 0, 1, 0, 0, 1, 0)),
    ((2, 2, 1, 0, 0, 0, 0, 0, 0), (130, 4, 1, 0, 0, 0, 0, 0, 1), (48, 0, 0, 0, 0, 0, 0, 0, 1), (2, 0, 0, 1, 0, 0, 0, 1, 0), (35, 0, 0, 0, 0, 0, 0, 1, 0), (80, 2, 1, 0, 0, 0, 0, 1, 0), (12, 0, 0, 0, 0, 0, 0, 1, 0)),
    # a sidebar, a cookie notice and a sign-up line as long as paragraphs, by markup or by wording
    ((28, 3, 1, 0, 0, 1, 1, 0, 0), (9, 0, 0, 1, 1, 0, 0, 0, 1), (150, 0, 0, 0, 1, 0, 0, 0, 1), (3, 0, 0, 0, 1, 0, 1, 0, 1), (44, 0, 0, 0, 1, 0, 0, 0, 1), (14, 0, 0, 0, 1, 0, 1, 0, 1), (31, 0, 0, 0, 1, 0, 1, 0, 1), (8, 0, 0, 0, 1, 0, 1, 0, 1), (4, 0, 0, 1, 0, 1, 0, 0, 0), (70, 0, 0, 0, 0, 1, 0, 0, 0), (38, 0, 0, 0, 0, 1, 0, 0, 0)),
    ((26, 0, 0, 0, 0, 0, 1, 0, 0), (6, 0, 0, 1, 0, 0, 0, 0, 1), (200, 8, 3, 0, 0, 0, 0, 0, 1), (61, 0, 0, 0, 0, 0, 0, 0, 1), (19, 2, 1, 0, 0, 0, 1, 0, 0), (33, 0, 0, 0, 0, 0, 0, 0, 1), (3, 3, 3, 0, 0, 0, 0, 0, 0), (11, 0, 0, 0, 0, 0, 1, 0, 0)),
    # a form and a byline inside an article; breadcrumbs of links with separators before it
    ((5, 3, 3, 0, 0, 0, 0, 0, 0), (10, 0, 0, 1, 1, 0, 0, 0, 1), (5, 2, 1, 0, 1, 0, 0, 0, 1), (84, 0, 0, 0, 1, 0, 0, 0, 1), (3, 0, 0, 0, 1, 1, 0, 0, 0), (2, 0, 0, 0, 1, 1, 0, 0, 0), (57, 9, 2, 0, 1, 0, 0, 0, 1), (7, 5, 4, 0, 1, 0, 0, 0, 0), (24, 0, 0, 0, 0, 1, 0, 0, 0)),
    # recipes and tables: many small blocks without links
    ((1, 1, 1, 0, 0, 1, 0, 0, 0), (4, 0, 0, 1, 1, 0, 0, 0, 1), (2, 0, 0, 0, 1, 0, 0, 0, 1), (1, 0, 0, 0, 1, 0, 0, 0, 1), (3, 0, 0, 0, 1, 0, 0, 0, 1), (2, 0, 0, 1, 1, 0, 0, 0, 1), (1, 0, 0, 0, 1, 0, 0, 0, 1), (15, 0, 0, 0, 1, 0, 0, 0, 1), (6, 0, 0, 0, 0, 1, 0, 0, 0)),
    # an article with paragraphs that are one link each, between prose of any length, and with rows of several links
    ((1, 1, 1, 0, 0, 1, 0, 0, 0), (6, 0, 0, 1, 1, 0, 0, 0, 1), (3, 3, 1, 0, 1, 0, 0, 0, 1), (12, 0, 0, 0, 1, 0, 0, 0, 1), (8, 8, 1, 0, 1, 0, 0, 0, 1), (90, 0, 0, 0, 1, 0, 0, 0, 1), (2, 2, 1, 0, 1, 0, 0, 0, 1),
     (3, 0, 0, 0, 1, 0, 0, 0, 1), (4, 4, 1, 0, 1, 0, 0, 0, 1), (60, 2, 1, 0, 1, 0, 0, 0, 1), (3, 3, 3, 0, 1, 0, 0, 0, 0), (25, 0, 0, 0, 1, 0, 0, 0, 1), (6, 6, 2, 0, 1, 0, 0, 0, 0), (110, 0, 0, 0, 1, 0, 0, 0, 1), (8, 8, 4, 0, 1, 0, 0, 0, 0), (4, 0, 0, 0, 1, 0, 0, 0, 1)),
    # lists of links inside articles after prose long and short, and before it
    ((70, 0, 0, 0, 1, 0, 0, 0, 1), (4, 4, 1, 0, 1, 0, 0, 0, 0), (5, 5, 1, 0, 1, 0, 0, 0, 0), (3, 3, 1, 0, 1, 0, 0, 0, 0), (20, 0, 0, 0, 1, 0, 0, 0, 1)),
    ((5, 0, 0, 1, 1, 0, 0, 0, 1), (30, 0, 0, 0, 1, 0, 0, 0, 1), (2, 2, 1, 0, 1, 0, 0, 0, 0), (2, 2, 1, 0, 1, 0, 0, 0, 0), (130, 0, 0, 0, 1, 0, 0, 0, 1), (10, 10, 1, 0, 1, 0, 0, 0, 0), (9, 9, 1, 0, 1, 0, 0, 0, 0), (7, 7, 1, 0, 1, 0, 0, 0, 0)),
    ((9, 0, 0, 1, 1, 0, 0, 0, 1), (5, 5, 1, 0, 1, 0, 0, 0, 1), (18, 0, 0, 0, 1, 0, 0, 0, 1), (1, 1, 1, 0, 1, 0, 0, 0, 1), (22, 0, 0, 0, 1, 0, 0, 0, 1), (9, 9, 1, 0, 1, 0, 0, 0, 1), (7, 0, 0, 0, 1, 0, 0, 0, 1), (3, 3, 1, 0, 1, 0, 0, 0, 1), (150, 0, 0, 0, 1, 0, 0, 0, 1),
     (6, 6, 1, 0, 1, 0, 0, 0, 1), (130, 0, 0, 0, 1, 0, 0, 0, 1), (4, 4, 1, 0, 1, 0, 0, 0, 1), (48, 0, 0, 0, 1, 0, 0, 0, 1), (12, 12, 1, 0, 1, 0, 0, 0, 1), (26, 0, 0, 0, 1, 0, 0, 0, 1), (2, 2, 1, 0, 1, 0, 0, 0, 1), (2, 0, 0, 0, 1, 0, 0, 0, 1)),
    # headings over prose and headings over links, inside articles, after blocks of any length
    ((7, 0, 0, 1, 1, 0, 0, 0, 1), (15, 0, 0, 0, 1, 0, 0, 0, 1), (3, 0, 0, 1, 1, 0, 0, 0, 0), (4, 4, 1, 0, 1, 0, 0, 0, 0), (6, 6, 1, 0, 1, 0, 0, 0, 0), (2, 0, 0, 1, 1, 0, 0, 0, 1), (68, 0, 0, 0, 1, 0, 0, 0, 1), (4, 0, 0, 1, 1, 0, 0, 0, 0), (5, 5, 1, 0, 1, 0, 0, 0, 0)),
    ((9, 0, 0, 1, 1, 0, 0, 0, 1), (200, 0, 0, 0, 1, 0, 0, 0, 1), (1, 0, 0, 1, 1, 0, 0, 0, 1), (140, 0, 0, 0, 1, 0, 0, 0, 1), (5, 0, 0, 1, 1, 0, 0, 0, 0), (3, 3, 1, 0, 1, 0, 0, 0, 0), (4, 4, 1, 0, 1, 0, 0, 0, 0), (71, 0, 0, 0, 1, 0, 0, 0, 1), (3, 0, 0, 1, 1, 0, 0, 0, 0), (8, 8, 3, 0, 1, 0, 0, 0, 0)),
    ((6, 0, 0, 1, 1, 0, 0, 0, 1), (2, 0, 0, 0, 1, 0, 0, 0, 1), (2, 0, 0, 1, 1, 0, 0, 0, 0), (7, 7, 1, 0, 1, 0, 0, 0, 0), (9, 9, 1, 0, 1, 0, 0, 0, 0), (95, 0, 0, 0, 1, 0, 0, 0, 1), (35, 0, 0, 0, 1, 0, 0, 0, 1), (4, 0, 0, 1, 1, 0, 0, 0, 0), (2, 2, 2, 0, 1, 0, 0, 0, 0)),
    ((8, 0, 0, 1, 1, 0, 0, 0, 1), (66, 0, 0, 0, 1, 0, 0, 0, 1), (82, 5, 1, 0, 1, 0, 0, 0, 1), (75, 0, 0, 0, 1, 0, 0, 0, 1), (70, 0, 0, 0, 1, 0, 0, 0, 1), (6, 0, 0, 0, 1, 0, 0, 0, 1), (80, 0, 0, 0, 1, 0, 0, 0, 1), (5, 0, 0, 0, 1, 0, 0, 0, 1), (16, 0, 0, 0, 0, 1, 0, 0, 0)),
    ((7, 0, 0, 1, 1, 0, 0, 0, 1), (50, 0, 0, 0, 1, 0, 0, 0, 1), (2, 0, 0, 0, 1, 0, 0, 0, 1), (3, 3, 3, 0, 1, 0, 0, 0, 0)),
    ((1, 0, 0, 0, 1, 0, 0, 0, 1), (2, 2, 2, 0, 1, 0, 0, 0, 0), (40, 0, 0, 0, 1, 0, 0, 0, 1), (4, 0, 0, 0, 1, 0, 0, 0, 1), (5, 5, 1, 0, 1, 0, 0, 0, 0), (6, 6, 1, 0, 1, 0, 0, 0, 0), (3, 0, 0, 1, 1, 0, 0, 0, 0), (4, 4, 1, 0, 1, 0, 0, 0, 0), (4, 4, 1, 0, 1, 0, 0, 0, 0), (2, 0, 0, 1, 1, 0, 0, 0, 0), (7, 7, 1, 0, 1, 0, 0, 0, 0)),
    ((30, 0, 0, 0, 1, 0, 0, 0, 1), (5, 0, 0, 0, 1, 0, 0, 0, 1), (2, 2, 2, 0, 1, 0, 0, 0, 0), (3, 0, 0, 0, 1, 0, 0, 0, 1), (5, 5, 3, 0, 1, 0, 0, 0, 0), (5, 0, 0, 1, 1, 0, 0, 0, 0), (6, 6, 1, 0, 1, 0, 0, 0, 0)),
    # no article elements: a site's name and motto among links, labels between links, a closing line after links
    ((5, 0, 0, 0, 0, 0, 0, 0, 0), (1, 1, 1, 0, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0, 0, 0, 0), (2, 2, 1, 0, 0, 0, 0, 0, 0), (8, 0, 0, 1, 0, 0, 0, 0, 1), (64, 0, 0, 0, 0, 0, 0, 0, 1), (7, 0, 0, 0, 0, 0, 0, 0, 1), (88, 7, 2, 0, 0, 0, 0, 0, 1), (4, 4, 1, 0, 0, 0, 0, 0, 0), (140, 0, 0, 0, 0, 0, 0, 0, 1),
     (3, 0, 0, 0, 0, 0, 0, 0, 0), (3, 3, 1, 0, 0, 0, 0, 0, 0), (1, 0, 0, 0, 0, 0, 0, 0, 0), (2, 2, 1, 0, 0, 0, 0, 0, 0), (9, 0, 0, 0, 0, 0, 0, 0, 0)),
    ((3, 0, 0, 0, 0, 0, 0, 0, 0), (2, 2, 2, 0, 0, 0, 0, 0, 0), (40, 0, 0, 0, 0, 0, 0, 0, 1), (5, 0, 0, 0, 0, 0, 0, 0, 1), (28, 0, 0, 0, 0, 0, 0, 0, 1), (6, 6, 2, 0, 0, 0, 0, 0, 0), (4, 0, 0, 0, 0, 0, 0, 0, 0), (4, 4, 1, 0, 0, 0, 0, 0, 0)),
    # pages that end with their article
    ((4, 0, 0, 1, 1, 0, 0, 0, 1), (60, 0, 0, 0, 1, 0, 0, 0, 1), (9, 0, 0, 0, 1, 0, 0, 0, 1)),
    ((2, 2, 1, 0, 0, 0, 0, 0, 0), (120, 0, 0, 0, 0, 0, 0, 0, 1), (7, 0, 0, 0, 0, 0, 0, 0, 1)),
    ((13, 0, 0, 0, 1, 0, 0, 0, 1), (10, 0, 0, 0, 1, 0, 0, 0, 1)),
    ((55, 1, 1, 0, 0, 0, 0, 0, 1), (6, 0, 0, 0, 0, 0, 0, 0, 1)),
    # no article elements: short headings over prose, single links between and after it
    ((2, 2, 1, 0, 0, 0, 0, 0, 0), (3, 0, 0, 1, 0, 0, 0, 0, 1), (44, 0, 0, 0, 0, 0, 0, 0, 1), (4, 0, 0, 1, 0, 0, 0, 0, 1), (81, 0, 0, 0, 0, 0, 0, 0, 1), (5, 5, 1, 0, 0, 0, 0, 0, 0), (50, 0, 0, 0, 0, 0, 0, 0, 1), (2, 2, 1, 0, 0, 0, 0, 0, 0)),
    ((1, 1, 1, 0, 0, 0, 0, 0, 0), (4, 4, 1, 0, 0, 0, 0, 0, 0), (5, 0, 0, 1, 0, 0, 0, 0, 1), (110, 6, 2, 0, 0, 0, 0, 0, 1), (2, 0, 0, 1, 0, 0, 0, 0, 1), (33, 0, 0, 0, 0, 0, 0, 0, 1), (3, 3, 1, 0, 0, 0, 0, 0, 0)),
    ((3, 3, 1, 0, 0, 0, 0, 0, 0), (4, 0, 0, 1, 0, 0, 0, 0, 1), (150, 0, 0, 0, 0, 0, 0, 0, 1), (8, 8, 1, 0, 0, 0, 0, 0, 0), (21, 0, 0, 0, 0, 0, 0, 0, 1), (5, 0, 0, 1, 0, 0, 0, 0, 0), (4, 4, 1, 0, 0, 0, 0, 0, 0), (6, 6, 1, 0, 0, 0, 0, 0, 0)),
    # menus after a notice or a site's name, and share bars after text of any length
    ((22, 0, 0, 0, 0, 1, 1, 0, 0), (1, 1, 1, 0, 0, 1, 0, 0, 0), (8, 0, 0, 0, 0, 1, 0, 0, 0), (2, 2, 1, 0, 0, 1, 0, 0, 0), (12, 0, 0, 1, 1, 0, 0, 0, 1), (3, 3, 3, 0, 1, 0, 0, 0, 0), (41, 0, 0, 0, 1, 0, 0, 0, 1), (15, 0, 0, 0, 1, 1, 0, 0, 0), (4, 4, 1, 0, 1, 1, 0, 0, 0), (8, 0, 0, 0, 1, 0, 0, 0, 1), (4, 4, 2, 0, 1, 0, 0, 0, 0)),
    ((14, 0, 0, 0, 0, 1, 0, 0, 0), (3, 3, 1, 0, 0, 1, 0, 0, 0), (17, 0, 0, 0, 1, 0, 0, 0, 1), (2, 2, 2, 0, 1, 0, 0, 0, 0), (20, 0, 0, 0, 1, 0, 0, 0, 1), (6, 6, 3, 0, 1, 0, 0, 0, 0), (19, 0, 0, 0, 0, 0, 0, 0, 1), (2, 2, 1, 0, 0, 0, 0, 0, 0), (12, 0, 0, 0, 0, 0, 0, 0, 1), (3, 3, 1, 0, 0, 0, 0, 0, 0)),
    # lines of a licence as paragraphs of an article
    ((20, 0, 0, 0, 1, 0, 0, 0, 1), (3, 0, 0, 0, 1, 0, 1, 0, 1), (9, 0, 0, 0, 1, 0, 0, 0, 1), (4, 0, 0, 0, 1, 0, 1, 0, 1), (45, 0, 0, 0, 1, 0, 0, 0, 1), (5, 0, 0, 0, 1, 0, 1, 0, 1), (9, 0, 0, 0, 0, 1, 1, 0, 0)),
    # short owners' lines after links and after text
    ((50, 0, 0, 0, 0, 0, 0, 0, 1), (2, 2, 1, 0, 0, 0, 0, 0, 0), (4, 0, 0, 0, 0, 0, 1, 0, 0)),
    ((90, 2, 1, 0, 0, 0, 0, 0, 1), (3, 0, 0, 0, 0, 0, 1, 0, 0)),
    ((70, 0, 0, 0, 0, 0, 0, 0, 1), (3, 3, 1, 0, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0, 1, 0, 0)),
    ((3, 3, 1, 0, 0, 0, 0, 0, 0), (5, 0, 0, 0, 0, 0, 1, 0, 0), (35, 0, 0, 0, 0, 0, 0, 0, 1)),
    # a page of links with hardly a text
    ((3, 3, 1, 0, 0, 0, 0, 0, 0), (4, 4, 1, 0, 0, 0, 0, 0, 0), (2, 0, 0, 1, 0, 0, 0, 0, 0), (5, 5, 1, 0, 0, 0, 0, 0, 0), (6, 4, 1, 0, 0, 0, 0, 0, 0), (9, 9, 2, 0, 0, 0, 0, 0, 0), (12, 10, 3, 0, 0, 0, 0, 0, 0)),
)


def grown(rows: list[tuple], depth: int = 9, least: int = 2):
    """A decision tree by Gini impurity: a share of main text at a leaf, else (feature, threshold, below, above)."""
    share = sum(r[-1] for r in rows) / len(rows)
    if share in (0, 1) or not depth:
        return share
    best = None
    for k in range(len(FEATURES)):
        values = sorted({r[k] for r in rows})
        for cut in ((a + b) / 2 for a, b in zip(values, values[1:])):
            parts = [r for r in rows if r[k] <= cut], [r for r in rows if r[k] > cut]
            if min(map(len, parts)) >= least:
                impurity = sum(len(p) * (s := sum(r[-1] for r in p) / len(p)) * (1 - s) for p in parts)
                if best is None or impurity < best[0] - 1e-12:
                    best = impurity, k, cut, parts
    if best is None:
        return share
    return best[1], best[2], *(grown(p, depth - 1, least) for p in best[3])


@cache
def tree():
    pages = [([Block(*b[:-1]) for b in page], [b[-1] for b in page]) for page in LABELLED]
    return grown([(*f, main) for found, mains in pages for f, main in zip(features(found), mains)])


def is_main(of: tuple) -> bool:
    node = tree()
    while isinstance(node, tuple):
        node = node[2] if of[node[0]] <= node[1] else node[3]
    return node >= 0.5


def main_text(page: str | None) -> str:
    texts, found = blocks(page)
    return "\n".join(text for text, of in zip(texts, features(found)) if is_main(of))


def extracted(pages: DataFrame) -> DataFrame:
    """pages with text and n_chars (code points) after its own columns.

    A null or empty html, and one without main text, has the empty text. Whole pages are read,
    however long; a tag, comment or script that never ends takes the rest of its page. Rows are
    independent, so repeats give repeats. Columns named text and n_chars are replaced.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], dtype=object)

    own = [c for c in pages.columns if c not in ("text", "n_chars")]
    return pages.withColumn("text", run("html")).select(*own, "text", F.char_length("text").cast("long").alias("n_chars"))
