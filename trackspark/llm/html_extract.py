"""Main text of web pages by two passes of block rules."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .textbytes import text_views

#: Common words of the languages that pages are in. Fixed values.
STOP_WORDS = frozenset(
    "a an and are as at be by for from has have he her his in is it its not of on or she that the their they this to was we were which will with you "
    "aber als am an auch auf aus bei bin das dass dem den der des die durch ein eine einem einen einer er es für haben hat ich im in ist mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war wie wir zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour que qui sa se ses son sont sur un une vous "
    "al como con de del el ella en es esta este ha la las lo los más me muy no nos o para pero por que se ser si sin sobre su sus un una y ya".split()
)
#: Tags whose content is never text of a page. Fixed values.
RAW = ("script", "style", "title", "noscript", "template", "iframe", "object", "svg", "canvas", "textarea", "select", "audio", "video", "head")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of which one open one ends where another begins.
CLOSES_P = BLOCK - {"body", "html"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements, roles and words of class or id that mark what is beside the article. Fixed values.
BESIDE_TAGS = frozenset("nav footer aside form button label menu dialog fieldset search".split())
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
BESIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo cookie cookies consent gdpr popup modal newsletter subscribe subscription signup "
    "sidebar sidenav nav navbar menu breadcrumb breadcrumbs toolbar masthead footer comment comments disqus share sharing social related recommended widget widgets pagination pager".split()
)
#: Words that mark only where nothing in the same name says otherwise: `legal` and `legal-box`, but not `legal-analysis`.
WEAK_WORDS = frozenset(
    "promotion banner notice notification alert overlay navigation topbar foot reply replies respond discussion recommendations login search skip copyright legal disclaimer header form".split()
)
#: Words of names that say where or how, not what; and those that begin a name of a state.
PLAIN_WORDS = frozenset("box bar area section container wrap wrapper block list item items content text inner outer top bottom left right site page global primary secondary main links link title body global fixed small".split())
STATE_WORDS = frozenset("has no not with without is".split())
#: Words of reader comments: what they mark never holds the article.
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond discussion".split())
MAIN_TAGS = frozenset(("article", "main"))

#: Characters of a short and of a long block; link density of a menu; stop-word densities of prose.
SHORT, LONG = 70, 200
LINKS = 0.33
FEW_STOPS, MANY_STOPS = 0.1, 0.25
#: Shares of a page's text outside links from which a marked element must be the page itself: with and without a main element in it.
HALF, MOST = 0.5, 0.67

GOOD, NEAR, BRIEF, BAD = "good", "near", "brief", "bad"

#: Elements open at once beyond which further ones are not told apart, as browsers do; their text counts all the same.
DEPTH = 512

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: What stands between a tag's name and its end or the next quoted value.
_BARE = re.compile(r"(?>[^>=]+|=(?!\s*[\"']))*+")
_QUOTE = re.compile(r"=\s*([\"'])")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[^\W\d_]+")
_PART = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}


@dataclass
class Block:
    text: str
    links: int
    heading: bool
    main: bool
    box: int
    weight: int
    beside: bool = False
    label: str = ""


@dataclass
class Box:
    """An element that its tag, role or names mark as beside the article, unless it turns out to hold the article."""

    parent: int
    in_main: bool
    comments: bool
    chars: int = 0
    mains: int = 0
    tops: int = 0


@dataclass
class _Open:
    tag: str
    box: int
    main: bool
    link: bool
    heading: bool
    weight: int


@dataclass
class _Walk:
    stack: list[_Open] = field(default_factory=lambda: [_Open("", -1, False, False, False, 0)])
    blocks: list[Block] = field(default_factory=list)
    boxes: list[Box] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    links: int = 0
    breaks: int = 0
    mains: int = 0
    tops: int = 0
    head: bool = False

    def say(self, raw: str) -> None:
        if not raw:
            return
        if raw.strip():
            self.breaks = 0
        text = html.unescape(raw)
        self.parts.append(text)
        if self.stack[-1].link:
            self.links += sum(map(len, text.split()))

    def end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                top = self.stack[-1]
                self.blocks.append(Block(text, self.links, top.heading, top.main, top.box, top.weight))
            self.parts, self.links = [], 0
        self.breaks = 0

    def pop_to(self, depth: int) -> None:
        del self.stack[depth:]

    def open(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.breaks += 1
            self.end_block() if self.breaks > 1 else self.parts.append(" ")
            return
        if tag in BLOCK:
            self.end_block()
            if tag in CLOSES_P:
                for k in range(len(self.stack) - 1, 0, -1):
                    if self.stack[k].tag == "p":
                        self.pop_to(k)
                        break
                    if self.stack[k].tag in BLOCK:
                        break
        for k in range(len(self.stack) - 1, 0, -1) if tag in SIBLINGS else ():
            if self.stack[k].tag in SIBLINGS[tag]:
                self.pop_to(k)
                break
            if self.stack[k].tag in ("ul", "ol", "dl", "table", "select"):
                break
        if tag in VOID:
            return
        top = self.stack[-1]
        main, weight, comments = top.main or tag in MAIN_TAGS, top.weight, False
        beside = tag in BESIDE_TAGS or (tag == "header" and not main)
        if attrs and tag not in ("html", "body"):
            for name, a, b, c in _ATTR.findall(attrs):
                name, value = name.lower(), (a or b or c).lower()
                if name == "role":
                    main, beside = main or value == "main", beside or value in BESIDE_ROLES
                elif name in ("class", "id") and tag not in MAIN_TAGS:
                    for word in value.split():
                        found = named(word)
                        beside, weight = beside or found == MARK and (main, word) != (True, "header"), weight + (found == WEIGHT)
                        comments = comments or found == MARK and not COMMENT_WORDS.isdisjoint(_PART.findall(word))
                elif name == "itemprop" and value == "articlebody":
                    main = True
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                    beside = True
        box = top.box
        if beside:
            box = len(self.boxes)
            self.boxes.append(Box(top.box, main and tag not in MAIN_TAGS, comments))
        if main and not top.main:
            self.mains += 1
            if box >= 0:
                self.boxes[box].mains += 1
        if tag == "h1":
            self.tops += 1
            if box >= 0:
                self.boxes[box].tops += 1
        if len(self.stack) < DEPTH:
            self.stack.append(_Open(tag, box, main, top.link or tag == "a", top.heading or tag in HEADING, weight))

    def close(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_block()
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                self.pop_to(k)
                return
            if self.stack[k].tag in BLOCK and tag not in BLOCK:
                return


MARK, WEIGHT = "mark", "weight"


def named(word: str) -> str:
    """What one name of a class or id says of its element: MARK (beside the article), WEIGHT (perhaps), or nothing."""
    parts = _PART.findall(word)
    if not parts or parts[0] in STATE_WORDS:
        return ""
    if not BESIDE_WORDS.isdisjoint(parts):
        return MARK
    if WEAK_WORDS.isdisjoint(parts):
        return ""
    return MARK if all(x in WEAK_WORDS or x in PLAIN_WORDS for x in parts) else WEIGHT


def _tag_end(page: str, at: int) -> tuple[int, bool]:
    """The end of the attributes from `at`, outside quoted values, and whether that was found; else the first > is taken, or -1."""
    to = at
    while True:
        to = _BARE.match(page, to).end()
        quote = _QUOTE.match(page, to)
        if not quote:
            return (to, True) if to < len(page) else (page.find(">", at), False)
        to = page.find(quote[1], quote.end()) + 1
        if not to:
            return page.find(">", at), False


def blocks(page: str) -> list[Block]:
    """The blocks of text of a page in order, from one scan of its tags; unclosed and crossing tags are tolerated.

    Every part of the page is looked at a bounded number of times: once a tag's quoted value has run past the page's
    end, quotes no longer hide the ends of tags.
    """
    walk, at, n, quotes = _Walk(), 0, len(page), True
    while at < n:
        start = page.find("<", at)
        if start < 0:
            walk.say(page[at:])
            break
        m, end = _NAME.match(page, start), -1
        if page.startswith("<!--", start):
            walk.say(page[at:start])
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if m:
            if quotes:
                end, quotes = _tag_end(page, m.end())
            else:
                end = page.find(">", m.end())
        elif page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
        if end < 0:  # no tag
            if m or page.startswith(("<!", "<?"), start):  # and none after it, as no > follows
                walk.say(page[at:])
                break
            walk.say(page[at : start + 1])
            at = start + 1
            continue
        walk.say(page[at:start])
        at = end + 1
        if not m:
            continue
        tag = m[2].lower()
        if m[1]:
            walk.close(tag)
        elif tag in _RAW_END:
            if tag == "head":
                if walk.head:  # a page has one
                    continue
                walk.head = True
                body = re.compile(r"</head\b|<body\b", re.I).search(page, _after_raw(page, at))
                at = body.start() if body else at
            else:
                end = _RAW_END[tag].search(page, at)
                if tag == "textarea" and walk.stack[-1].main:
                    walk.end_block()
                    walk.say(page[at : end.start() if end else n])
                    walk.end_block()
                at = end.end() if end else n
        else:
            walk.open(tag, page[m.end() : end])
    walk.end_block()
    _beside(walk)
    return walk.blocks


def _beside(walk: _Walk) -> None:
    """Tells which blocks are beside the article: those within a marked element, unless that holds the page's own text.

    An element that is not part of the main element holds it if all main elements lie within, with half of the page's text or
    more, or, where there is no main element, if most of the text lies within and each h1. Reader comments never do.
    """
    total = 0
    for b in walk.blocks:
        chars = len(b.text) - b.links
        total += chars
        if b.box >= 0:
            walk.boxes[b.box].chars += chars
    for x in reversed(walk.boxes):
        if x.parent >= 0:
            up = walk.boxes[x.parent]
            up.chars, up.mains, up.tops = up.chars + x.chars, up.mains + x.mains, up.tops + x.tops
    beside = []
    for x in walk.boxes:
        whole = x.mains == walk.mains and x.chars >= HALF * total if walk.mains else x.tops == walk.tops and x.chars >= MOST * total
        holds = whole and not x.in_main and not x.comments
        beside.append(not holds or x.parent >= 0 and beside[x.parent])
    for b in walk.blocks:
        b.beside = b.box >= 0 and beside[b.box]


def _after_raw(page: str, at: int) -> int:
    """The end of the last script, style or title of a head, within which </head> would be text."""
    for m in re.compile(r"<(script|style|title)\b", re.I).finditer(page, at):
        if m.start() < at:
            continue
        stop = re.compile(r"</head\b|<body\b", re.I).search(page, at, m.start())
        if stop:
            break
        end = _RAW_END[m[1].lower()].search(page, m.end())
        at = end.end() if end else len(page)
    return at


def stop_density(text: str) -> float:
    found = _WORD.findall(text)
    return sum(w.lower() in STOP_WORDS for w in found) / max(1, len(found))


def first_pass(b: Block, has_main: bool, prose: bool) -> str:
    """A block's label by itself: GOOD or BAD when decided, else NEAR (long enough, unsure) or BRIEF.

    `prose`: whether the page's candidates are by and large prose of a language of STOP_WORDS; only then is a block nearly
    without stop words held to be none, and never within the main element, where long blocks without links are text: code, tables, another script.
    """
    if b.beside or (has_main and not b.main):
        return BAD
    size = sum(map(len, b.text.split())) or 1
    if b.links / size > LINKS and not (b.main and b.heading):
        return BAD
    if not has_main and ("©" in b.text[:40] or re.match(r"(?i)copyright\b", b.text)):
        return BAD
    if len(b.text) < SHORT:
        return BRIEF
    stops = stop_density(b.text)
    if stops >= MANY_STOPS and (len(b.text) >= LONG or b.main) or b.main and len(b.text) >= LONG:
        return GOOD
    if b.weight and not b.main and stops < MANY_STOPS or not b.main and stops < FEW_STOPS and (prose or len(b.text) < LONG):
        return BAD
    return NEAR


def classify(page_blocks: list[Block]) -> None:
    """Labels all blocks GOOD or BAD. In the second pass, undecided blocks inherit from the nearest decided neighbours;
    where these differ, NEAR counts as text, and BRIEF only before text if it is a heading, or in the page's main element. Without any
    decided text, undecided blocks of the main element are text, and elsewhere NEAR ones are."""
    has_main = any(b.main and not b.beside for b in page_blocks)
    own = [b.text for b in page_blocks if not b.beside and (b.main or not has_main) and not b.links]
    prose = stop_density(" ".join(own)) >= 2 * FEW_STOPS
    first = [first_pass(b, has_main, prose) for b in page_blocks]
    decided = [x if x in (GOOD, BAD) else None for x in first]
    if has_main:  # what lies beside the main element says nothing about what lies in it
        decided = [None if x == BAD and (b.beside or not b.main) else x for x, b in zip(decided, page_blocks, strict=True)]
    before, after, last = [], [], None
    for x in decided:
        before.append(last)
        last = x or last
    last = None
    for x in reversed(decided):
        after.append(last)
        last = x or last
    after.reverse()
    for b, x, left, right in zip(page_blocks, first, before, after, strict=True):
        if x in (GOOD, BAD):
            b.label = x
        elif GOOD not in decided:
            b.label = GOOD if has_main or x == NEAR else BAD
        elif b.heading and right == GOOD:
            b.label = GOOD
        elif (left or right) == (right or left):
            b.label = left or right
        else:
            b.label = GOOD if x == NEAR or has_main else BAD


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    classify(found)
    return "\n\n".join(b.text for b in found if b.label == GOOD)


SCHEMA = "page_id bigint, url string, text string, n_chars bigint"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row: one pass, no shuffle; each page is handled alone, whole.

    A null or empty html, or a page without main text, gives the empty text; null page_id and url stay; repeated rows
    are answered alike; an empty table gives no rows; other columns, whatever their names, are ignored. A page is read in time in proportion to its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in text_views(batches, "html"):
            texts = [main_text(h) for h in rows.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    storage.bound_batches(pages.sparkSession)
    cols = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return cols.mapInArrow(run, SCHEMA)
