"""Main text of web pages by two-pass block rules.

A page is cut into blocks of text at block-level tags.  The first pass classes every block by
the density of stop words, the density of links and its length as good, bad, near-good or
short; the second pass gives ambiguous blocks the label of their nearest decided neighbours.
Text within what a page marks as menus, headers, footers, sidebars, notices, adverts, forms,
scripts and comments is never main text.  An article that a page marks is evidence for both
passes: within it a block may hold more links, near-good counts as good, and what no neighbour
decides is good; outside it the thresholds stay and what no neighbour decides is bad.  Labels
of neighbours do not pass its edge.  A marked article without running text on a page that has
some outside of it, such as a teaser card, is no evidence.

Defined cases: a null or empty page gives the empty text; unclosed and crossing tags end with
their container; a script, style or comment that is never closed ends with the page; white
space inside a block, a single line break included, is one space; two line breaks in a row
end a block; repeated rows give equal texts; an empty table gives no rows; extra columns never
matter.  Pages are read whole and stay where they are: one narrow pass without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.common import query, small_batches, table

#: Thresholds of the first pass: link density, lengths in characters, shares of stop words.
MAX_LINKS, SHORT, LONG = 0.2, 70, 200
STOP_LOW, STOP_HIGH = 0.2, 0.3
#: Link density that a block within a marked article may have.
ARTICLE_LINKS = 0.5
#: Headings reach this far for a good block that follows.
HEADING_REACH = 200

#: Function words of the languages that pages come in.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be because been but by can could do for from had has have he her his how i if in into is it "
    "its me more my no not of on one or other our out she so some than that the their them then there these they this to up us was we were "
    "what when which who will with would you your "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es für hat ich ihr im in "
    "ist ja kann mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais mes ne nous on ou par pas pour qu que qui sa "
    "sans se ses son sont sur te tu un une vous "
    "al como con cuando de del donde el ella en entre era es esta este esto fue ha hasta la las lo los mas me mi muy no nos o para pero por que "
    "se ser si sin sobre son su sus también te un una y ya yo".split()
)
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
#: Tags whose text is never main text.
DROPPED_TAGS = frozenset(
    "nav header footer aside form fieldset select option button textarea input label menu dialog head title noscript template svg math canvas "
    "object applet audio video iframe map datalist".split()
)
#: Tags whose content is not markup.
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role names that mark other content than main text.
DROPPED_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|adsense|advertorial|banner|sponsor|sponsored|sponsors|promo|promotion|"
    r"cookie|cookies|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|paywall|"
    r"nav|navbar|navigation|menu|menus|breadcrumb|breadcrumbs|pagination|pager|toolbar|topbar|header|masthead|footer|sidebar|sidebars|side|"
    r"widget|widgets|related|recommended|recommendations|share|sharing|social|comment|comments|commentlist|respond|reply|replies|disqus|"
    r"discussion|login|search|searchform|tags|skip|complementary|contentinfo|hidden|teaser|outbrain|taboola)(?:$|[\s_-])", re.IGNORECASE)
MAIN_NAMES = re.compile(r"(?:^|\s)(?:main|article|main-content|post-content|entry-content|article-body|articlebody|story-body)(?:$|\s)", re.IGNORECASE)

_TOKEN = re.compile(r"<!--(?:.*?--!?>|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|</?([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[A-Za-z][^>]*\Z", re.DOTALL)
_NAME = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?(?=[\s/"']|$)""", re.IGNORECASE)
_SPACES = re.compile(r"[\s\x00]+")
_WORDS = re.compile(r"\w+")


@dataclass
class Block:
    """Text of a block and what the rules ask about it."""

    parts: list[str] = field(default_factory=list)
    linked: int = 0
    heading: bool = False
    dropped: bool = False
    article: bool = False
    text: str = ""
    label: str = ""


def _marks(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether a tag marks other content, and whether it marks the article."""
    if tag in DROPPED_TAGS:
        return True, False
    dropped, article = False, tag in ("article", "main")
    if attributes.strip():
        for name, a, b, c in _NAME.findall(attributes):
            value, name = a or b or c, name.lower()
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE)):
                dropped = True
            elif name in ("class", "id", "role") and tag not in ("body", "html", "article", "main"):
                dropped |= bool(DROPPED_NAMES.search(value)) or value.lower() == "form"
                article |= bool(MAIN_NAMES.search(value))
    return dropped, article and not dropped


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order, their text decoded and its white space made one."""
    found: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, dropped so far, in an article so far
    now, links, breaks, at = Block(), 0, 0, 0

    def close() -> None:
        nonlocal now, breaks
        breaks = 0
        now.text = _SPACES.sub(" ", "".join(now.parts)).strip()
        if now.text:
            found.append(now)
        _, dropped, article = stack[-1] if stack else ("", False, False)
        now = Block(dropped=dropped, article=article, heading=any(tag in HEADINGS for tag, _, _ in stack[-3:]))

    def add(raw: str) -> None:
        nonlocal breaks
        if raw:
            text = unescape(raw)
            if text.strip():
                breaks = 0
                if links:
                    now.linked += len(_SPACES.sub(" ", text).strip())
            now.parts.append(text)

    end = len(page)
    while at < end:
        match = _TOKEN.search(page, at)
        if not match:
            add(page[at:])
            break
        add(page[at : match.start()])
        at = match.end()
        tag = (match[1] or "").lower()
        if not tag:
            continue
        if match[0].startswith("</"):
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK_TAGS or any(name == tag for name, _, _ in stack):
                if tag in BLOCK_TAGS:
                    close()
                if any(name == tag for name, _, _ in stack):
                    while stack.pop()[0] != tag:
                        pass
                    _, dropped, article = stack[-1] if stack else ("", False, False)
                    if (now.dropped, now.article) != (dropped, article) or tag in BLOCK_TAGS:
                        close()
                links = 0 if tag in BLOCK_TAGS else links
            continue
        attributes = match[2]
        if tag == "br":
            breaks += 1
            now.parts.append(" ")
            if breaks > 1:
                close()
            continue
        if tag in VOID_TAGS:
            if tag in BLOCK_TAGS:
                close()
            continue
        if tag == "a":
            links += 1
            continue
        if tag in RAW_TAGS:
            closing = re.compile(rf"</{tag}\s*/?>", re.IGNORECASE).search(page, at)
            at = closing.end() if closing else end
            if tag in BLOCK_TAGS:
                close()
            continue
        drop, art = _marks(tag, attributes)
        if tag in BLOCK_TAGS:
            if tag in ("p", "li", "dd", "dt", "option", "tr", "td", "th") and not attributes.rstrip().endswith("/"):
                # these end their own kind within one container
                for name, _, _ in reversed(stack):
                    if name == tag or (tag == "p" and name in HEADINGS):
                        while stack.pop()[0] != name:
                            pass
                        break
                    if name in BLOCK_TAGS and name not in ("p", "td", "th", "tr", "dd", "dt"):
                        break
            _, dropped, article = stack[-1] if stack else ("", False, False)
            stack.append((tag, dropped or drop, article or art))
            links = 0
            close()
        elif drop or art:
            _, dropped, article = stack[-1] if stack else ("", False, False)
            stack.append((tag, dropped or drop, article or art))
            close()
    close()
    return found


def _stop_share(block: Block) -> float:
    words = _WORDS.findall(block.text)
    return sum(w.lower() in STOP_WORDS for w in words) / max(1, len(words))


def _first_pass(block: Block, stop: float, known: bool, article: bool = False) -> str:
    """``known``: whether the page's language is one whose stop words are listed; else length alone counts.

    ``article``: whether a mark of the page speaks for the block.
    """
    length = len(block.text)
    if block.linked / length > (ARTICLE_LINKS if article else MAX_LINKS):
        return "short" if article and block.heading else "bad"
    if "\xa9" in block.text and (length < LONG or not article):
        return "bad"
    if length < SHORT:
        return "short"
    if stop >= STOP_HIGH and length > LONG:
        return "good"
    if stop >= STOP_LOW or not known:
        return "good" if article else "near"
    return "bad" if block.linked and not article else "short"


def _second_pass(first: list[str], tie: str = "good") -> list[str]:
    """Ambiguous blocks take the label of the nearest decided one; a tie, or none at all, is ``tie``."""
    label = list(first)
    for kinds in ({"good", "bad"}, {"good", "bad", "near"}):
        decided = [i for i, x in enumerate(label) if x in kinds and x != "short"]
        which = "near" if kinds == {"good", "bad"} else "short"
        now = list(label)
        for i, x in enumerate(label):
            if x == which:
                now[i] = _closest(decided, label, i, tie)
        label = now
    return label


def _closest(decided: list[int], label: list[str], i: int, tie: str) -> str:
    at = bisect(decided, i)
    some = [(abs(i - j), label[j] != tie, label[j]) for j in decided[max(0, at - 2) : at + 2] if j != i]
    return min(some)[2] if some else tie


def _decide(some: list[Block], first: list[str], tie: str) -> None:
    """Labels of blocks that may lend each other theirs, from those of the first pass."""
    label = _second_pass(first, tie)
    # headings go with the good block that follows closely
    for i, b in enumerate(some):
        if b.heading and label[i] != "good" and b.linked == 0:
            reach, j = 0, i + 1
            while j < len(some) and reach <= HEADING_REACH:
                if label[j] == "good":
                    label[i] = "good"
                    break
                reach += len(some[j].text)
                j += 1
    for b, x in zip(some, label, strict=True):
        b.label = x


def classify(page: list[Block]) -> list[Block]:
    """Labels ``good`` and ``bad`` for all blocks of a page."""
    for b in page:
        b.label = "bad"
    open_blocks = [b for b in page if not b.dropped]
    stops = [_stop_share(b) for b in open_blocks]
    known = any(s >= STOP_LOW and len(b.text) >= SHORT for s, b in zip(stops, open_blocks, strict=True))
    first = [_first_pass(b, s, known) for b, s in zip(open_blocks, stops, strict=True)]
    running = {b.article for b, x in zip(open_blocks, first, strict=True) if x in ("good", "near")}
    if running == {False} or not any(b.article for b in open_blocks):
        _decide(open_blocks, first, "good")
        return page
    for article, run in groupby(zip(open_blocks, stops, strict=True), lambda x: x[0].article):
        side = list(run)
        _decide([b for b, _ in side], [_first_pass(b, s, known, article) for b, s in side], "good" if article else "bad")
    return page


def main_text(page: str | None) -> str:
    """Main text of a page: its good blocks in order, one per line."""
    return "\n".join(b.text for b in classify(blocks(page or "")) if b.label == "good")


def extracted(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns and ``text`` of every page."""
    small_batches(pages.sparkSession)
    names = [f"k{i}" for i in range(len(keep))]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x) for x in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], texts], [*names, "text"])

    rows = pages.select(F.col(html).alias("html"), *[F.col(k).alias(n) for k, n in zip(keep, names, strict=True)])
    schema = ", ".join([*[f"{n} {pages.schema[k].dataType.simpleString()}" for k, n in zip(keep, names, strict=True)], "text string"])
    return rows.mapInArrow(task, schema).select(*[F.col(n).alias(k) for k, n in zip(keep, names, strict=True)], "text")


@query("op3_html_text")
def op3_html_text(spark: SparkSession, folder: str) -> DataFrame:
    out = extracted(table(spark, folder, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
