"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags and at two line breaks in a row. A block knows its text, its link density (share of
characters inside links), its stop-word density, and where it stands.

First pass, each block on its own:

* bad: in a menu, page header, footer, sidebar, notice, advert, form or the readers' comments, as told by tags, roles, and class or
  id; mostly links; a copyright line; or outside the main part on a page that marks one (as an article or, for lack of one, as main
  or by a usual class or id);
* good: inside the marked main part; elsewhere long enough and with enough stop words;
* near: elsewhere middling long with enough stop words, or long with fewer;
* short: too short to tell, or a heading.

A page in a language without stop words here is told by lengths and links alone.

Second pass, ambiguous blocks in context: a near block is good unless both of its nearest decided neighbours are bad; a short block
inherits the label of its nearest decided neighbours: if they agree theirs, else that of the nearer one, counted in blocks, and bad
if both are as near. A heading inherits from what follows it. An edge of the page counts as bad. If no block is decided as
good, the near blocks are; if there is none either, places that only tags of menus, headers and forms name are looked into, as a form or
an element without its end tag may hold the whole page.

Scripts, styles, templates and other elements without prose are never text. Character references are decoded once, white space in
a block becomes one space, and blocks that are good are joined by line feeds in page order.

Defined results: null and empty pages, and pages without a good block, have an empty text; repeated rows and rows without an id stay;
missing end tags are made up for, an unclosed comment or script runs to the end of the page. Pages of any length are
read whole in one walk of linear time. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame

from strideflow.llm.common import filled, release, steps
from strideflow.llm.quality import COMMON

STOP_WORDS = frozenset(COMMON)

# Lengths in characters and shares of words or characters.
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.06, 0.15
LINK_HIGH, LINK_ARTICLE = 0.2, 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Their content is not markup; it ends at their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
# Elements without prose.
SILENT = frozenset("head template svg math canvas audio video object select button datalist map picture dialog".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENCLOSING = frozenset(("article", "main"))
# A start tag of the same kind ends the open one, up to the nearest of the elements that hold it.
CLOSES = {
    "li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)),
    "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table")), "option": frozenset(("select",)),
}

# Places that an article inside them overrides (a missing end tag, or a form around the whole page), and those it does not.
SOFT, HARD = "soft", "hard"
TAG_PLACES = {
    "nav": SOFT, "menu": SOFT, "header": SOFT, "form": SOFT, "fieldset": SOFT, "footer": HARD, "aside": HARD,
}
ROLE_PLACES = {
    "navigation": SOFT, "menu": SOFT, "menubar": SOFT, "banner": SOFT, "search": SOFT, "form": SOFT, "tablist": SOFT, "toolbar": SOFT,
    "contentinfo": HARD, "complementary": HARD, "alert": HARD, "alertdialog": HARD, "dialog": HARD,
}
# Words of a class or id that name a place.
MENU_WORDS = frozenset(
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager toolbar search searchbox searchform login signin "
    "signup skip skiplink sitenav topnav mainnav".split()
)
HEADER_WORDS = frozenset("header masthead topbar logo brand branding tagline sitetitle".split())
HARD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adunit sponsor sponsored sponsors promo promotion banner footer "
    "colophon copyright imprint impressum legal sidebar sidebars aside rail widget widgets notice notices cookie cookies consent gdpr "
    "privacy alert popup modal overlay newsletter subscribe subscription paywall announcement announcements disclaimer toast infobar "
    "comment comments commentlist commentbox discussion disqus respond response responses reply replies guestbook "
    "share sharing social related recommended recommendations recirculation trending popular mostread teaser teasers outbrain taboola "
    "werbung anzeige hinweis kommentar kommentare publicite commentaire commentaires publicidad anuncio anuncios aviso comentario "
    "comentarios".split()
)
# Headings above the readers' comments.
COMMENTS_HEADING = re.compile(
    r"(?:\d+\s+|(?:reader|user|your|all|view|show|leave|write|post)\w*\s+(?:a\s+|all\s+)?)*"
    r"(?:comments?|repl(?:y|ies)|kommentare?|leserkommentare?|commentaires?|comentarios?)\s*(?:\(\d+\)|:|\d+)?", re.I,
)
# Whole names of a class or id, without hyphens, that mark the main part where no article does.
MAIN_NAMES = frozenset(
    "article post story entry content main articlebody postbody storybody entrycontent postcontent articlecontent storycontent maincontent "
    "pagecontent contentmain articletext posttext bodytext maintext".split()
)
ARTICLE, MAIN = 2, 1
# Compound names whose words alone would mislead.
NOT_PLACES = re.compile(r"(?:no|without|has|with|hide)[-_]?(?:sidebars?|ads?|comments?|nav|header|footer)\b", re.I)
WORDS_IN_NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")

MARKUP = re.compile(
    r"<!--(?:>|->)?|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*+)(?P<rest>(?>[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<(?:[!?]|/(?![a-zA-Z]))[^>]*+>?"
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
COMMENT_END = re.compile(r"--!?>")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


@dataclass(slots=True)
class Block:
    text: str
    link: float
    place: str | None
    part: int  # ARTICLE, MAIN or 0
    heading: bool


@dataclass(slots=True)
class Element:
    tag: str
    place: str | None = None
    part: int = 0
    silent: bool = False
    began: int = 0  # blocks of articles before it


PAGE = Element("")


def _names(value: str) -> tuple[set[str], set[str]]:
    """The words of a class or id, split at hyphens, underscores and capitals; and each name as a whole."""
    words, whole = set(), set()
    for name in NOT_PLACES.sub(" ", value).split():
        words.update(w.lower() for w in WORDS_IN_NAME.findall(name))
        whole.add(re.sub(r"[-_\d]+", "", name).lower())
    return words | whole, whole


def _attributes(rest: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(rest):
        out.setdefault(name.lower(), html.unescape("".join(values)))
    return out


class Walk:
    """Blocks of a page, gathered in one pass over its markup."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack: list[Element] = []
        self.at: dict[str, list[int]] = defaultdict(list)  # where the stack holds each kind of element
        self.pieces: list[str] = []
        self.linked = self.breaks = self.main_blocks = 0
        self.link_depth = -1  # depth of the stack where the open link began

    def top(self) -> Element:
        return self.stack[-1] if self.stack else PAGE

    def innermost(self, tags: frozenset[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at[t]), default=-1)

    def text(self, raw: str) -> None:
        if self.top().silent:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if text.strip():
            if self.breaks > 1:
                self.end_block()
            self.breaks = 0
        self.pieces.append(text)
        if self.link_depth >= 0:
            self.linked += len("".join(text.split()))

    def end_block(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            top = self.top()
            solid = len(text) - text.count(" ")
            heading = any(e.tag in HEADINGS for e in self.stack[-3:])
            self.main_blocks += top.part == ARTICLE and top.place is None
            self.blocks.append(Block(text, min(1.0, self.linked / solid), top.place, top.part, heading))
        self.pieces.clear()
        self.linked = self.breaks = 0

    def start(self, tag: str, rest: str) -> None:
        if tag == "br":
            self.breaks += 1
            self.pieces.append(" ")
            return
        if tag == "a":
            self.link_depth = len(self.stack) if "href" in rest.lower() else -1
        inline = tag in INLINE
        if not inline:
            self.end_block()
            if tag in VOID:
                return
            if self.top().tag == "p":
                self.pop(len(self.stack) - 1)
            if tag in CLOSES and self.at[tag] and self.at[tag][-1] > self.innermost(CLOSES[tag]):
                self.pop(self.at[tag][-1])
        above = self.top()
        element = self.placed(tag, _attributes(rest) if "=" in rest or "hidden" in rest else {})
        if inline:
            # Inline elements are only kept where they name a place of their own.
            if (element.place, element.silent) == (above.place, above.silent) and above.tag != tag:
                return
            self.end_block()
        self.at[tag].append(len(self.stack))
        self.stack.append(element)

    def placed(self, tag: str, attributes: dict[str, str]) -> Element:
        above = self.top()
        words, whole = _names(f"{attributes.get('class', '')} {attributes.get('id', '')}") if attributes else (set(), set())
        role = attributes.get("role", "").lower()
        place = TAG_PLACES.get(tag) or ROLE_PLACES.get(role)
        if tag == "header" and above.part:
            place = None  # the article's own heading
        if tag not in ("html", "body", "main"):
            if words & HARD_WORDS:
                place = HARD
            elif words & MENU_WORDS or words & HEADER_WORDS and not above.part and not words & MAIN_NAMES:
                place = place or SOFT
        silent = above.silent or tag in SILENT or "hidden" in attributes or (
            bool(attributes) and (INVISIBLE.search(attributes.get("style", "")) is not None or attributes.get("aria-hidden", "").lower() == "true")
        )
        part = 0
        if tag == "article" or role == "article" or attributes.get("itemprop", "").lower() == "articlebody":
            part = ARTICLE
        elif tag == "main" or role == "main" or tag not in ("html", "body") and tag not in INLINE and whole & MAIN_NAMES:
            part = MAIN
        outer = self.at["article"]
        if part == ARTICLE and outer and self.main_blocks > self.stack[outer[-1]].began:
            place = HARD  # an article within the text of another is a reader's comment
        if part and place is None and above.place != HARD:
            return Element(tag, None if tag in ("article", "main") else above.place, max(part, above.part), silent, self.main_blocks)
        place = HARD if HARD in (place, above.place) else place or above.place
        return Element(tag, place, above.part, silent)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link_depth = -1
        if tag in INLINE:
            if self.top().tag == tag:
                self.end_block()
                self.pop(len(self.stack) - 1)
            return
        self.end_block()
        # A stray end tag inside an article does not end the article.
        if self.at[tag] and (self.at[tag][-1] >= self.innermost(ENCLOSING) or tag in ENCLOSING or tag in ("body", "html")):
            self.pop(self.at[tag][-1])

    def pop(self, k: int) -> None:
        for element in self.stack[k:]:
            self.at[element.tag].pop()
        del self.stack[k:]
        if self.link_depth > len(self.stack):
            self.link_depth = -1


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order."""
    walk, at = Walk(), 0
    while True:
        found = MARKUP.search(page, at)
        if found is None:
            walk.text(page[at:])
            break
        if found.start() > at:
            walk.text(page[at:found.start()])
        at = found.end()
        tag = found["tag"]
        if tag is None:
            if found[0] == "<!--":
                end = COMMENT_END.search(page, at)
                at = end.end() if end else len(page)
            continue
        tag = tag.lower()
        if found["end"]:
            walk.end(tag)
            continue
        if tag in RAW and not found["rest"].endswith("/"):
            if tag not in INLINE:
                walk.end_block()
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        walk.start(tag, found["rest"])
    walk.end_block()
    return walk.blocks


GOOD, BAD, NEAR, UNSURE = "good", "bad", "near", "short"


def stop_density(text: str) -> float:
    words = LETTERS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def first_label(block: Block, marked: int, known: bool, strict: bool) -> str:
    """What a block is by itself.

    ``marked``: the surest mark of a main part on the page; ``known``: whether the page has stop words at all;
    ``strict``: whether the weaker places count.
    """
    if block.place == HARD or block.place and strict or marked and not block.part:
        return BAD
    if marked and block.part == marked:
        return BAD if block.link > LINK_ARTICLE else GOOD
    if block.link > LINK_HIGH or "©" in block.text or block.text.lower().startswith("copyright "):
        return BAD
    if block.heading:
        return UNSURE
    if len(block.text) < SHORT:
        return BAD if block.link else UNSURE
    density = stop_density(block.text) if known else 1.0
    if density >= STOP_HIGH:
        return GOOD if len(block.text) > LONG else NEAR
    return NEAR if density >= STOP_LOW else BAD


def commented(found: list[Block]) -> list[Block]:
    """The blocks with those below a heading of readers' comments placed among them."""
    out, below = [], False
    for block in found:
        below = below or block.heading and not block.place and COMMENTS_HEADING.fullmatch(block.text) is not None
        out.append(replace(block, place=HARD) if below and not block.place else block)
    # On a page that is nothing else the heading means something else.
    return out if any(not b.place for b in out) else found


def over_links(found: list[Block], i: int) -> bool:
    """Whether a heading stands over a list of links."""
    below = next((b for b in found[i + 1:i + 9] if not b.place), None)
    return below is not None and not below.heading and below.link > LINK_ARTICLE


def decided(found: list[Block]) -> list[bool]:
    """Whether each block belongs to the main text, after the second pass."""
    found = commented(found)
    marked = max((b.part for b in found if b.place is None), default=0)
    known = any(stop_density(b.text) >= STOP_LOW for b in found if len(b.text) >= SHORT and not b.place and b.link <= LINK_HIGH)
    labels = [first_label(b, marked, known, True) for b in found]
    if GOOD not in labels and NEAR not in labels:
        labels = [first_label(b, marked, known, False) for b in found]
    if GOOD not in labels:
        labels = [GOOD if x == NEAR else x for x in labels]
    labels = [BAD if x == GOOD and found[i].heading and over_links(found, i) else x for i, x in enumerate(labels)]
    n = len(labels)
    # Nearest decided block before and after each block; the edges are bad.
    before, after = [(-1, BAD)] * n, [(n, BAD)] * n
    seen = (-1, BAD)
    for i in range(n):
        before[i] = seen
        if labels[i] in (GOOD, BAD):
            seen = (i, labels[i])
    seen = (n, BAD)
    for i in reversed(range(n)):
        after[i] = seen
        if labels[i] in (GOOD, BAD):
            seen = (i, labels[i])
    out = []
    for i, label in enumerate(labels):
        (a, left), (b, right) = before[i], after[i]
        if label == NEAR:
            label = GOOD if GOOD in (left, right) else BAD
        elif label == UNSURE and found[i].heading:
            label = right
        elif label == UNSURE:
            label = left if left == right or i - a < b - i else right if b - i < i - a else BAD
        out.append(label == GOOD)
    return out


def main_text(page: str) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, good in zip(found, decided(found)) if good)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) in; page_id, url, text, n_chars out, one row per row."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = filled(batch.column("html"))
            for a, b in steps(raw):
                texts = [main_text(page) for page in raw.slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id").slice(a, b - a), batch.column("url").slice(a, b - a), pa.array(texts, pa.string()),
                     pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )
        release()

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return pages.select("page_id", "url", "html").mapInArrow(extracted, f"{kinds}, text string, n_chars long")
