"""Main text of web pages by the distribution of text over blocks of lines.

Markup is stripped into lines, one for each block element. WINDOW empty lines part
two lines if a container (div, section and the like) ends and another one begins
between them, or if a dropped element stood between lines of different containers.
The text length of a line, without its links, is summed over a sliding window of
WINDOW lines; a surge point is a window whose sum passes SURGE (or is the page's
largest), and the text runs on to the dive point, the next window without any text.
Lines between the two are kept whole, short ones too, with the lines that lead up to
the surge. Of runs that dives part, those with less than SHARE of the longest one's
text are asides.

Dropped before that are elements that by their name hold menus, footers, sidebars,
forms, scripts or styles, a header outside an article, hidden elements, and containers
whose class, id or role says so: a name all of whose words are in MARKS or GENERIC, one
at least in MARKS ("ad", "site-footer", not "social-history"). Such a container stays
if it holds most of the page's text without links. An element that no end tag of its
name follows isn't dropped, so what comes after it stays.

An article or main element is a hint only: its edges part runs, and containers, gaps
and links in it don't, but what it holds and what stands outside pass the same tests.

Defined results: null or empty html, and pages without text, give an empty text;
repeated rows are handled row by row; null ids and urls stay null; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from itertools import takewhile
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlode.llm.batches import documents, map_batches

WINDOW, SURGE, SHARE = 3, 86, 0.2

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*+)>|<[!?][^>]*+>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video xmp noframes".split())
#: Elements that part runs of text and that a class may drop.
CONTAINERS = frozenset("article aside body center details dialog div footer form header main nav section".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("nav footer aside form header menu dialog head button select option fieldset label datalist".split())
#: Words in a class, id or role that mark what isn't the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments commentlist consent contentinfo cookie cookies copyright "
    "discussion disqus disclaimer footer form gdpr header legal login masthead menu menubar modal nav navbar navigation newsletter notice notification overlay "
    "pager pagination popup privacy promo promotion recommended related replies reply respond responses search share sharing sidebar signup sitemap social "
    "sponsor sponsored subscribe subscription tags teaser toolbar topbar widget".split()
)
#: Words that may stand beside one of MARKS in a name.
GENERIC = frozenset("area bar block body bottom box container content entry group heading inner item items left link links list main module page panel post posts right row section site sub text title top unit wrap wrapper".split())
#: Those that a header inside an article may carry.
TITLE_MARKS = frozenset({"header", "byline"})
#: Words that, standing with one of MARKS, tell that the element holds the article itself.
CONTENT_MARKS = frozenset({"article", "content", "entry", "main", "post", "story"})


#: Words of MARKS that mark readers' words, which may be longer than the article.
READERS_MARKS = frozenset("comment comments commentlist discussion disqus replies reply respond responses".split())

#: Words of MARKS that mark paid text; it stays only where nothing else does.
PAID_MARKS = frozenset("ad ads advert adverts advertisement advertising adsense promo promotion sponsor sponsored".split())


class Line(NamedTuple):
    text: str
    length: int
    article: int
    #: The containers that it lies in, outermost first.
    path: tuple[int, ...] = ()
    #: Whether an element was dropped since the line before.
    after_gap: bool = False


class Held(NamedTuple):
    """An element dropped for a word: where its tag ends, its words, the text in it without links."""

    at: int
    words: frozenset[str]
    length: list[int]


def _dropped(name: str, attributes: str, in_article: bool) -> bool | frozenset[str]:
    """Whether an element is dropped, or the words that it is dropped for."""
    if name in DROPPED and not (name == "header" and in_article):
        return True
    if not attributes or name in ("body", "html"):
        return False
    words: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return True
        if key in ("class", "id", "role"):
            for token in value.split():
                parts = {w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if w}
                if name in CONTAINERS or name in ("ul", "ol", "dl", "table"):
                    words |= parts if not parts - MARKS - GENERIC else parts & CONTENT_MARKS
    marked = words & MARKS
    if in_article or name in ("article", "main"):
        marked -= TITLE_MARKS
    return False if name in ("article", "main") and words & CONTENT_MARKS and not marked & {"comment", "comments", "reply"} else frozenset(marked)


def lines(page: str) -> list[Line]:
    """The page's blocks in order.

    An element that is dropped for its words stays if it holds most of the page's text
    without links, and more than SURGE; one of READERS_MARKS does so only if no window of
    the rest passes SURGE, one of PAID_MARKS only if the rest has no text.
    """
    kept: set[int] = set()
    while True:
        found, held = _lines(page, kept)
        rest = [line.length for line in found]
        total = sum(rest) + sum(h.length[0] for h in held)
        most = max(held, key=lambda h: h.length[0], default=None)
        if most is None or most.length[0] <= max(SURGE, total / 2) or most.words & (READERS_MARKS | PAID_MARKS) and any(x > (0 if most.words & PAID_MARKS else SURGE) for x in window_sums(rest)):
            return found
        kept.add(most.at)


def _lines(page: str, kept: set[int]) -> tuple[list[Line], list[Held]]:
    """The lines, and the outermost elements that are dropped for their words; those of kept aren't."""
    out: list[Line] = []
    held: list[Held] = []
    parts: list[str] = []
    lower = page.lower()
    links = linked = 0
    stack: list[tuple[str, str, int]] = []  # element, what it is ("", "article", "main", "worded" or "dropped") and where it begins
    kinds = {"dropped": 0, "worded": 0, "article": 0, "main": 0}
    number = 0
    gap = False
    last_end: dict[str, int] = {}

    def never_ends(name: str, at: int) -> bool:
        if name not in last_end:
            last_end[name] = lower.rfind(f"</{name}")
        return last_end[name] < at

    def end_line() -> None:
        nonlocal linked, gap
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                path = tuple(at for name, _, at in stack if name in CONTAINERS)
                out.append(Line(text, max(0, len(text) - linked), number if kinds["article"] else -number if kinds["main"] else 0, path, gap))
                gap = False
            parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not kinds["dropped"]:
            text = entities.unescape(text) if "&" in text else text
            if kinds["worded"]:
                held[-1].length[0] += 0 if links else len(" ".join(text.split()))
                return
            parts.append(text)
            if links:
                linked += len(text)

    def leave(n: int) -> None:
        nonlocal gap
        while len(stack) > n:
            kind = stack.pop()[1]
            if kind:
                kinds[kind] -= 1
                gap |= kind in ("dropped", "worded")

    at = 0
    while m := _TAG.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name == "br":
            say(" ")
            continue
        if name in BLOCK:
            end_line()
        if closing:
            if name == "a":
                links = max(0, links - 1)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    leave(i)
                    break
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                close = None if never_ends(name, at) else re.compile(rf"</{name}(?![A-Za-z0-9])[^>]*>", re.I).search(page, at)
                if close:
                    at = close.end()
                elif name in ("script", "style"):  # its code goes on to the next element
                    after = _TAG.search(page, at)
                    at = after.start() if after else len(page)
            continue
        if name in VOID:
            continue
        if name == "a":
            links = 1  # links don't nest
        if name == "body":  # a head without an end
            leave(next((i for i, s in enumerate(stack) if s[0] == "head"), len(stack)))
        if name == "p" or name == "li":
            same = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in (name, "div", "ul", "ol", "article", "section", "td", "blockquote")), -1)
            if same >= 0 and stack[same][0] == name:
                leave(same)
        kind = ""
        if not kinds["dropped"]:
            why = _dropped(name, attributes, bool(kinds["article"]))
            if why and never_ends(name, at):
                why = False
            if why is True or why and at not in kept and not kinds["worded"]:
                kind = "dropped" if why is True else "worded"
                end_line()
                if why is not True:
                    held.append(Held(at, why, [0]))
            elif name in ("article", "main"):
                kind = name
                number += not kinds["article"]
        stack.append((name, kind, at))
        if kind:
            kinds[kind] += 1
    say(page[at:])
    end_line()
    return out, held


def _parted(found: list[Line]) -> list[Line]:
    """The lines with WINDOW empty ones between those that containers or dropped elements part."""
    out: list[Line] = []
    for line in found:
        if out and not (line.article and out[-1].article and not line.after_gap) and not (line.article and line.article == out[-1].article):
            before, here = out[-1].path, line.path
            common = sum(1 for _ in takewhile(lambda ends: ends[0] == ends[1], zip(before, here, strict=False)))
            if line.after_gap and before != here or len(before) > common < len(here):
                out += [Line("", 0, 0)] * WINDOW
        out.append(line)
    return out


def _segments(found: list[Line]) -> list[list[Line]]:
    """The lines, parted where a marked article begins or ends."""
    out: list[list[Line]] = [[]]
    inside = None
    for line in found:
        if line.text:
            if inside not in (None, bool(line.article)):
                out.append([])
            inside = bool(line.article)
        out[-1].append(line)
    return out


def window_sums(weights: list[int]) -> list[int]:
    """Of the window that begins at each line."""
    total = [0]
    for w in weights:
        total.append(total[-1] + w)
    return [total[min(i + WINDOW, len(weights))] - total[i] for i in range(len(weights))]


def runs(weights: list[int], surge: int) -> list[tuple[int, int]]:
    """Where each run of text begins, and where it dives."""
    sums, found, i = window_sums(weights), [], 0
    while i < len(sums):
        if sums[i] <= surge or not weights[i]:
            i += 1
            continue
        start = i
        while start and weights[start - 1]:  # the lead-in of the surge
            start -= 1
        while i < len(sums) and sums[i]:
            i += 1
        found.append((start, i))
    return found


def blocks(page: str | None) -> list[str]:
    """The blocks of the main text in page order."""
    segments = _segments(_parted(lines(page or "")))
    weights = [[len(line.text) if line.article else line.length for line in s] for s in segments]
    surge = min(SURGE, max((x for w in weights for x in window_sums(w)), default=0) - 1)
    regions = [(sum(w[a:b]), s[a:b]) for s, w in zip(segments, weights, strict=True) for a, b in runs(w, surge)]
    least = SHARE * max((t for t, _ in regions), default=0)
    return [line.text for t, region in regions if t >= least for line in region if line.text]


def extract(page: str | None) -> str:
    return "\n\n".join(blocks(page))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, the main text and its code points."""
    table = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(h) for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(table, each, "page_id long, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(documents(spark, sf_dir, "pages"))
