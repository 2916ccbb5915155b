"""Main text of HTML pages by two passes of block rules.

The markup is cut into text blocks at block-level elements.  First pass: each block is classified
alone, by its stop-word density, length and link density, and by the boilerplate elements and
names around it.  Second pass: blocks too short to be decided alone take the label of their
nearest decided neighbours; where these disagree, they count as boilerplate unless they are close
to the text on the side of a heading.  Stop words decide only on pages that have them; a block
without a decided neighbour of boilerplate is text.  Articles that hold most of the page's text
are kept, but for the elements that are never text and those named as comments, adverts, notices and
the like, and nothing else is; others count for nothing.

Every step is linear in the page: the stack's entries know what surrounds them, and named elements form
a tree that is judged once.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Common words of some languages.
STOP_WORDS = frozenset(
    """
    a about after all also an and are as at be been but by can for from had has have he her his i if in
    into is it its more no not of on one or our out she so some than that the their them there they this
    to up was we were what when which who will with would you your
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais même ne
    nous on ou où par pas plus pour qu que qui sa se ses son sont sur un une vous à été être
    aber als am an auch auf aus bei bin bis da das dass dem den der des die dies diese durch ein eine
    einem einen einer es für hat ich ihr im in ist mit nach nicht noch nur oder sein sich sie sind so über
    um und von vor war was wenn werden wie wir wird zu zum zur
    al como con cuando del desde donde el ella en entre era es esta este fue ha hay la las lo los más me mi
    muy no nos o para pero por porque que se ser si sin sobre su sus también te tiene un una y ya
    """.split()
)

#: Elements whose content is never text of the page.
_SKIPPED = frozenset("script style noscript template iframe object svg math canvas audio video select option "
                     "textarea button datalist head title meta link".split())
#: Elements whose content is outside the article, wherever they stand.
_OUTSIDE = frozenset("nav footer aside form menu dialog fieldset".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre "
    "search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the first name ends at a start tag of the others.
_CLOSED_BY = {
    "p": _BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"},
}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose own names say nothing.
_UNNAMED = _HEADINGS | {"html", "body", "main", "article"}
#: Whole words of class, id and role; blocks below such an element are no text of the page.
_BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsored comments comment-list commentlist comments-area "
    "disqus_thread respond cookie-notice cookie-banner cookie-consent gdpr complementary contentinfo".split()
)
#: Weaker ones, which also name parts of texts; blocks below them must be text by themselves.
_WEAK_NAMES = frozenset(
    "banner promo cookies consent popup modal overlay newsletter subscribe signup login nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar widget footer site-footer page-footer site-header masthead topbar toolbar replies "
    "related related-posts related-articles recommended share sharing share-buttons social social-share pagination "
    "pager search search-form skip-link copyright".split()
)
#: Words that make a name of boilerplate, alone or beside words that say nothing.
_BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored comment comments disqus "
    "cookie cookies gdpr consent alert alerts notice notices".split()
)
_WEAK_WORDS = frozenset(
    "banner promo popup modal overlay newsletter subscribe signup login nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar widget replies related recommended share sharing social pagination pager search copyright".split()
)
_PLAIN_WORDS = frozenset(
    "box block section container wrapper wrap area list thread item items inner outer content row col column group panel "
    "unit slot zone bar text message messages top bottom left right header footer side inline mobile desktop sticky post "
    "article entry page site user reader js info warning danger success primary dismissible sm md lg".split()
)
_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")
_BETWEEN_WORDS = re.compile(r"[-_\d]+")
_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*)(?:>|$)""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?![\w-])""", re.IGNORECASE)
_SPACE = re.compile(r"\s+")


@dataclass(eq=False)
class Named:
    """An element with a name of boilerplate."""

    weak: bool
    inside: bool  # in an article or main element
    parent: Named | None = None  # the next one around it
    holds: bool = False  # an article or main element, as all around it do
    below: int = 0  # weight of the text in it, and of that in articles
    within: int = 0
    rules_out: bool = False  # all in it, and what is no text by itself
    doubts: bool = False


@dataclass
class Block:
    """A run of text between block-level boundaries."""

    parts: list[str]
    linked: int  # characters inside links
    outside: bool  # in an element that is never part of the article
    inside: bool  # in an article or main element
    heading: bool
    named: Named | None = None  # the innermost element around it whose name suggests boilerplate
    text: str = ""


def _attributes(attributes: str) -> tuple[str, bool]:
    """The class, id and role of a tag; whether it is hidden."""
    names, hidden = [], False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id", "role"):
            names.append(value)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            hidden = True
    return " ".join(names), hidden


def judged_names(names: str) -> str:
    """ "bad" or "weak" if any of the names suggests boilerplate, else "".

    A name is known whole, or it is made of words of boilerplate and words that say nothing; any other
    word in it makes it a name of something else.
    """
    out = ""
    for name in names.split():
        known = name.lower()
        words = {w for w in _BETWEEN_WORDS.split(_CASE.sub("-", name).lower()) if w and w not in _PLAIN_WORDS}
        if known in _BAD_NAMES or (known not in _WEAK_NAMES and words and words <= _BAD_WORDS):
            return "bad"
        if known in _WEAK_NAMES or (words and words <= _BAD_WORDS | _WEAK_WORDS):
            out = "weak"
    return out


@dataclass
class Open:
    """An open element, with what it and those around it say."""

    name: str
    outside: bool = False
    inside: bool = False
    heading: bool = False
    named: Named | None = None
    block: int = -1  # place on the stack of the innermost block-level element


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order.

    Comments and skipped elements vanish; open elements are kept on a stack, so that a block knows
    what surrounds it; end tags that nothing opened are ignored.
    """
    out: list[Block] = []
    stack: list[Open] = []
    opened: Counter[str] = Counter()
    endless: set[str] = set()  # skipped elements that no end tag follows any more
    now: Block | None = None

    def add(raw: str) -> None:
        nonlocal now
        if now is None:
            e = stack[-1] if stack else Open("")
            now = Block([], 0, e.outside, e.inside, e.heading, e.named)
            out.append(now)
        now.parts.append(raw)
        if opened["a"]:
            now.linked += len(raw)

    def close(place: int) -> None:
        for e in stack[place:]:
            opened[e.name] -= 1
        del stack[place:]

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            add(html.escape(m[1]))
            continue
        if m[3] is None:
            continue
        closing, name = bool(m[2]), m[3].lower()
        if closing:
            if name in _BLOCKS:
                now = None
            if opened[name]:
                place = len(stack) - 1
                while stack[place].name != name:
                    place -= 1
                close(place)
            continue
        if name in _SKIPPED and name not in _VOID and not m[4].endswith("/"):
            # Its content is no markup; what is not closed reaches to the end of the page.
            tail = None
            if name not in endless:
                tail = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
            if tail:
                at = tail.end()
            elif name in ("script", "style", "noscript", "template", "iframe", "textarea", "svg", "math"):
                at = end
            else:
                endless.add(name)
            continue
        if name == "br":
            if now is not None:
                now.parts.append("\n")
            continue
        if name in _BLOCKS:
            now = None
        while stack and name in _CLOSED_BY.get(stack[-1].name, ()):
            close(len(stack) - 1)
        # A paragraph also ends below open inline elements, which end with it.
        if name in _BLOCKS and stack and stack[-1].block >= 0 and stack[stack[-1].block].name == "p":
            close(stack[-1].block)
        if name in _VOID or m[4].endswith("/"):
            continue
        around = stack[-1] if stack else Open("")
        inside, named = around.inside, around.named
        names, hidden = _attributes(m[4]) if m[4] and not m[4].isspace() else ("", False)
        outside = around.outside or name in _OUTSIDE or hidden or (name == "header" and not inside)
        if names and name in _BLOCKS and name not in _UNNAMED and (kind := judged_names(names)):
            named = Named(kind == "weak", inside, named)
        if name in ("article", "main"):
            inside, e = True, named
            while e and not outside and not e.holds:
                e.holds, e = True, e.parent
        block = len(stack) if name in _BLOCKS else around.block
        stack.append(Open(name, outside, inside, around.heading or name in _HEADINGS, named, block))
        opened[name] += 1
    for b in out:
        b.text = _SPACE.sub(" ", html.unescape("".join(b.parts))).strip()
    return [b for b in out if b.text]


@dataclass(frozen=True)
class Rules:
    """Thresholds of the first pass."""

    link_density: float = 0.33  # of blocks outside articles
    short_chars: int = 70
    long_chars: int = 200
    stop_low: float = 0.10
    stop_high: float = 0.25
    heading_reach: int = 200


RULES = Rules()


def _named_elements(blocks: list[Block]) -> list[Named]:
    """The named elements around any block, outer ones first."""
    seen: dict[Named, None] = {}
    for b in blocks:
        chain, e = [], b.named
        while e and e not in seen:
            chain.append(e)
            e = e.parent
        seen.update(dict.fromkeys(reversed(chain)))
    return list(seen)


def _ruled_out(blocks: list[Block], text: list[bool]) -> list[bool]:
    """Whether the elements or names around each block rule it out.

    ``text`` says which blocks are text by themselves.  A name does not count on an element that
    holds an article, unless another article has most of the page's text.  In an article, it does not count on one that
    holds all of the article's text or, if the name is weak, most of the page's; elsewhere, on one that holds
    most of the page's text, unless the name is not weak and an article stands beside it.
    """
    weights = [0 if b.outside else max(len(b.text) - b.linked, 0) for b in blocks]
    total, articles = sum(weights), sum(w for b, w in zip(blocks, weights, strict=True) if b.inside)
    elements = _named_elements(blocks)
    for e in elements:
        e.below = e.within = 0
    for b, w in zip(blocks, weights, strict=True):
        if b.named:
            b.named.below += w
            b.named.within += w * b.inside
    for e in reversed(elements):
        if e.parent:
            e.parent.below += e.below
            e.parent.within += e.within

    def counts(e: Named) -> bool:
        beside = articles - e.within
        if e.holds:
            return 2 * beside > total
        return (beside > 0 and not e.weak) or 2 * e.below <= total

    for e in elements:
        here = counts(e)
        e.rules_out = (here and not e.weak) or bool(e.parent and e.parent.rules_out)
        e.doubts = (here and e.weak) or bool(e.parent and e.parent.doubts)
    return [
        b.outside or bool(b.named and (b.named.rules_out or (b.named.doubts and not t)))
        for b, t in zip(blocks, text, strict=True)
    ]


def _trusted(blocks: list[Block], outside: list[bool]) -> bool:
    """Whether articles hold most of the page's text, links left out unless there is nothing else."""
    seen = [b for b, out in zip(blocks, outside, strict=True) if not out]
    weights = [max(len(b.text) - b.linked, 0) for b in seen]
    if not any(weights):
        weights = [len(b.text) for b in seen]
    return 2 * sum(w for w, b in zip(weights, seen, strict=True) if b.inside) > sum(weights)


def _stops(text: str) -> tuple[int, int]:
    """Number of stop words and of words."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words), len(words)


def classify(blocks: list[Block], rules: Rules = RULES) -> list[bool]:
    """Whether each block is main text."""
    text = [len(b.text) >= rules.short_chars and b.linked <= rules.link_density * len(b.text) for b in blocks]
    outside = _ruled_out(blocks, text)
    if _trusted(blocks, outside):
        return [b.inside and not out for b, out in zip(blocks, outside, strict=True)]
    # Stop words decide only where the page has them; else its language is none of theirs.
    counts = [_stops(b.text) for b, t, out in zip(blocks, text, outside, strict=True) if t and not out]
    known = sum(c[0] for c in counts) >= rules.stop_low * max(sum(c[1] for c in counts), 1)
    labels: list[str] = []
    for b, out in zip(blocks, outside, strict=True):
        n = len(b.text)
        links = b.linked / max(n, 1)
        stops, words = _stops(b.text)
        stops /= max(words, 1)
        if out:
            labels.append("bad")
        elif links > rules.link_density and not b.heading:
            labels.append("bad")
        elif n < rules.short_chars:
            labels.append("bad" if b.linked else "short")
        elif stops >= rules.stop_high or not known:
            labels.append("good" if n > rules.long_chars else "near")
        elif stops >= rules.stop_low:
            labels.append("near")
        else:
            labels.append("plain")
    final = list(labels)
    # Where no block stands alone, the undecided ones are all the text there is.
    alone = "good" not in labels and "near" not in labels
    decided = ("good", "bad")
    # Ambiguous blocks: the nearest decided label before and after, in the first pass's labels.
    before, last = [], ""
    for k in labels:
        before.append(last)
        last = k if k in decided else last
    after, last = [], ""
    for k in reversed(labels):
        after.append(last)
        last = k if k in decided else last
    after.reverse()
    for i, (b, k) in enumerate(zip(blocks, labels, strict=True)):
        if k in decided:
            continue
        sides = {before[i], after[i]} - {""}
        if "bad" not in sides or alone:
            final[i] = "good"
        elif "good" not in sides:
            # A longer block with stop words stands alone, as does a long one of code, names or figures.
            stands = k == "near" or (k == "plain" and len(b.text) > rules.long_chars)
            final[i] = "good" if stands and not b.linked else "bad"
        else:
            final[i] = "good" if k in ("near", "plain") or (b.heading and after[i] == "good") else "bad"
    return [k == "good" for k in final]


def main_text(page: str | None) -> str:
    """The main text, one line per block; empty for a null or empty page."""
    if not page:
        return ""
    blocks = blocks_of(page)
    return "\n".join(b.text for b, good in zip(blocks, classify(blocks), strict=True) if good)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p.as_py()) for p in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_main_text(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null, empty and text-free pages give an empty text; repeated rows are extracted again; other
    columns are not read; an empty table gives no rows.  A narrow job, a page at a time, in time linear in
    the page, however its elements nest.
    """
    return df.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page)
    ).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
