"""Main text of web pages: block rules in two passes over a tolerant reading of the markup."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

# Common function words of the languages that are read, by language.
STOP_WORDS = {
    "en": "a an and are as at be but by for from had has have he her his if in into is it its no not of on or our she so that the their them then there these they this to was we were which who will with would you your",
    "fr": "à au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas pour que qui sa se ses son sont sur un une vous",
    "de": "als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und von vor war wie wird zu zum zur",
    "es": "a al como con de del desde el ella en entre es esta este ha la las lo los más me mi no nos o para pero por que se ser si sin sobre son su sus también un una y ya",
}
STOPS = frozenset(w for words in STOP_WORDS.values() for w in words.split())
# Elements by the part they play in a page.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
CHROME = frozenset("nav footer aside form menu dialog button select fieldset".split())
DROPPED = frozenset("script style head title noscript template iframe object svg math canvas textarea audio video map".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW = frozenset("script style title textarea noscript iframe template".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in class, id and role that name what is not the article.
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner popup modal overlay cookie cookies consent gdpr notice notices alert disclaimer nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager sidebar side aside widget widgets rail related recommended recommendations teaser teasers toc header masthead topbar footer foot bottombar copyright legal comment comments commentlist disqus reply replies discussion respond reviews share sharing social follow subscribe subscription newsletter signup login search tags taglist toolbar skip hidden complementary contentinfo".split()
)
NOT_CHROME = frozenset("article main".split())
# Words beside which a header is the article's own, and words that only tell of a part elsewhere.
OWN_HEADER, OF_HEADERS = frozenset("article entry post story content".split()), frozenset("header masthead".split())
TELLS_OF = frozenset("has with without no is".split())
# Words in class, id, role and itemprop that name the article where no element does.
ARTICLE_WORDS = frozenset("article articlebody entry post story content maincontent main text".split())
# Elements that end where another of their kind begins.
SUCCESSIVE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
NAMES = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
WORD_PARTS = re.compile(r"[a-z]+")
EDGES = re.compile(r"^\W+|\W+$")
# Signs with which lines about rights begin.
RIGHTS = re.compile(r"\W{0,2}(?:[©®]|\(c\)|copyright\b|all rights reserved\b)", re.I)


#: Elements by which it is told how near two blocks are, from the outermost.
DEEPEST = 64


@dataclass
class Rules:
    """Thresholds of the two passes; lengths in code points."""

    short: int = 70
    long: int = 200
    stops: float = 0.30
    few_stops: float = 0.15
    links: float = 0.33
    item_links: float = 0.9


@dataclass
class Block:
    text: str
    linked: int
    chrome: bool
    inside: bool
    heading: bool = False
    item: bool = False
    named: bool = False
    within: tuple[int, ...] = ()  # the elements that it lies in, from the outermost
    label: str = field(default="")


def is_chrome(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element opens a part that isn't the article."""
    if name in CHROME or name == "header" and not inside:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for key, a, b, c in NAMES.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return True
        for part in value.split() if key in ("class", "id", "role") else ():
            words = WORD_PARTS.findall(part)
            named = CHROME_WORDS.intersection(words)
            if named and words[0] not in TELLS_OF and not (named <= OF_HEADERS and OWN_HEADER.intersection(words)):
                return True
    return False


def names_article(attributes: str) -> bool:
    """Whether an element is called what articles are called."""
    found = NAMES.findall(attributes) if attributes else ()
    return any(key.lower() in ("class", "id", "role", "itemprop") and not ARTICLE_WORDS.isdisjoint(WORD_PARTS.findall((a or b or c).lower())) for key, a, b, c in found)


def blocks(html: str) -> list[Block]:
    """Blocks of text in page order, with what the markup says of each."""
    out: list[Block] = []
    parts: list[str] = []
    # name; 1 within a form, 2 in another part that isn't the article; in an article; in what is called one
    opened: list[tuple[str, int, bool, bool]] = []
    apart, inside, named, linked, anchors = 0, False, False, 0, 0
    within: list[int] = []
    open_names: Counter = Counter()
    made = 0
    tag, own = "", False  # the block's element, and whether it is itself no part of the article

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(text, min(linked, len(text)), apart > 0 or own, inside, tag in HEADINGS, tag == "li", named, tuple(within[:DEEPEST])))
        parts.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if anchors:
            linked += len(" ".join(unescape(text).split()))

    def leave(i: int) -> None:
        nonlocal apart, inside, named
        close()
        open_names.subtract(o[0] for o in opened[i:])
        del opened[i:], within[i:]
        apart, inside, named = opened[-1][1:] if opened else (0, False, False)

    at, size = 0, len(html)
    while at < size:
        m = TOKEN.search(html, at)
        if not m:
            take(html[at:])
            break
        if m.start() > at:
            take(html[at : m.start()])
        at = max(m.end(), at + 1)
        name, ends = (m[2] or "").lower(), bool(m[1])
        if not name:
            continue
        if name in RAW and not ends:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if name in BLOCKS:
            close()
            tag, own = ("", False) if ends else (name, name == "p" and is_chrome(name, m[3], inside))
        elif name == "a":
            anchors = max(0, anchors + (-1 if ends else 1))
        if name in EMPTY or name == "p":
            continue
        if ends:
            if open_names[name] > 0:
                leave(next(i for i in range(len(opened) - 1, -1, -1) if opened[i][0] == name))
            continue
        kinds = SUCCESSIVE.get(name, ())
        last = next((i for i in range(len(opened) - 1, -1, -1) if opened[i][0] not in SUCCESSIVE or opened[i][0] in kinds), None)
        if last is not None and opened[last][0] in kinds:
            leave(last)
        chrome = name in DROPPED or is_chrome(name, m[3], inside)
        if m[3].endswith("/") or not (name in BLOCKS or chrome):
            continue
        close()
        if name in ("body", "main") or name == "article" and apart < 2:
            while open_names["head"] > 0:
                at_head = next(i for i, o in enumerate(opened) if o[0] == "head")
                open_names["head"] -= 1
                del opened[at_head], within[at_head]
            apart, inside = 0, bool(opened) and opened[-1][2]
        inside = inside or name in NOT_CHROME and not chrome
        named = named or not chrome and name in ("div", "section", "td") and names_article(m[3])
        apart = max(apart, (1 if name == "form" else 2) if chrome else 0)
        opened.append((name, apart, inside, named))
        open_names[name] += 1
        made += 1
        within.append(made)
    close()
    return out


def stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(w in STOPS or EDGES.sub("", w) in STOPS for w in words) / max(1, len(words))


def first_pass(block: Block, rules: Rules, article: bool) -> str:
    """good, bad, or open: near (a text like any), short, and sparse (longer, with few stop words).

    article: whether the markup names one in this page; then what lies outside of it is no part of it.
    """
    if block.chrome or article and not block.inside:
        return "bad"
    if block.linked > (rules.links if not block.inside else rules.item_links if block.item else 1) * len(block.text):
        return "bad"
    if not block.inside and RIGHTS.match(block.text):
        return "bad"
    if len(block.text) < rules.short:
        return "short"
    density = stop_density(block.text)
    if density >= rules.few_stops and (len(block.text) > rules.long or block.inside and density >= rules.stops):
        return "good"
    return "near" if density >= rules.few_stops or block.inside else "sparse"


def common(a: Block, b: Block) -> int:
    """How many elements two blocks both lie in, from the outermost."""
    return next((i for i, (x, y) in enumerate(zip(a.within, b.within, strict=False)) if x != y), min(len(a.within), len(b.within)))


def nearest(i: int, found: list[Block], before: int, after: int) -> int:
    """The nearest of two decided neighbours: the one that shares more elements, else by blocks between, else the one before; -1 if there is none."""
    if before < 0 or after < 0:
        return max(before, after)
    shares = common(found[i], found[before]), common(found[i], found[after])
    if shares[0] != shares[1]:
        return before if shares[0] > shares[1] else after
    return before if i - before <= after - i else after


def neighbours(found: list[Block]) -> tuple[list[int], list[int]]:
    """Of each block the decided one before it and the one after it, -1 if there is none."""
    out: tuple[list[int], list[int]] = ([-1] * len(found), [-1] * len(found))
    for places, side in ((range(len(found)), out[0]), (range(len(found) - 1, -1, -1), out[1])):
        last = -1
        for i in places:
            side[i] = last
            last = i if found[i].label in ("good", "bad") else last
    return out


OPEN = ("near", "short", "sparse")


def seed(found: list[Block]) -> None:
    """Where no block is good by itself, the longest open one of the element that holds most of what is open counts as good."""
    size: Counter = Counter()
    for b in found:
        if b.label in OPEN:
            size[b.within] += len(b.text)
    if size:
        most = max(size.values())
        place = next(b.within for b in found if size[b.within] == most)
        max((b for b in found if b.within == place and b.label in OPEN), key=lambda b: len(b.text)).label = "good"


def classify(found: list[Block], rules: Rules) -> list[Block]:
    """The article's blocks.

    First pass: markup, link density, length and density of stop words decide a block by itself; if that leaves none
    that is good, the element with the most open text has it. Second pass: first
    headings that are open take the label of the next decided block, then open blocks that of the nearest decided
    neighbour, where blocks of the same element are nearer than all others. Within what the markup names an article
    an open block is dropped only if it is partly linked and stands among dropped ones.
    """
    if not any(b.inside and not b.chrome for b in found):
        for b in found:
            b.inside = b.named
    article = any(b.inside and not b.chrome for b in found)
    for b in found:
        b.label = first_pass(b, rules, article)
    if not any(b.label == "good" for b in found):
        seed(found)
    for headings in (True, False):
        before, after = neighbours(found)
        labels = []
        for i, b in enumerate(found):
            if b.label in ("good", "bad") or headings and not b.heading:
                labels.append(b.label)
            elif b.inside:
                beside = [found[k] for k in (before[i], after[i]) if k >= 0 and found[k].inside and not found[k].chrome]
                labels.append("bad" if b.linked and beside and all(x.label == "bad" for x in beside) else "good")
            elif headings:
                # A heading stands over what follows it, if that lies in the same elements or further in.
                k = after[i]
                labels.append(found[k].label if k >= 0 and common(b, found[k]) >= len(b.within) - 1 else b.label)
            else:
                k = nearest(i, found, before[i], after[i])
                good = b.label == "near" if k < 0 else found[k].label == "good"
                # Few stop words are no prose, but may stand in the midst of it.
                apart = b.label == "sparse" and (k < 0 or common(b, found[k]) < len(b.within))
                labels.append("good" if good and not apart else "bad")
        for b, label in zip(found, labels, strict=True):
            b.label = label
    return [b for b in found if b.label == "good"]


def main_text(html: str | None, rules: Rules | None = None) -> str:
    """Text of the article's blocks in page order, joined by one space; empty if there is none."""
    return " ".join(b.text for b in classify(blocks(html or ""), rules or Rules()))


def extract(pages: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages` (page_id, url, html).

    Reads the whole markup. Null, empty and text-free pages give an empty text and 0. Repeated rows stay, null ids
    and urls pass through, an empty table gives an empty result; other columns are not read.
    """
    rules = rules or Rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py(), rules) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    prepare(pages.sparkSession)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
