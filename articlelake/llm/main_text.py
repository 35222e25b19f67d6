"""Main text of web pages by two-pass block rules.

Pass one cuts the page into blocks and decides the clear ones: by link density, length and
stop-word density, and by the containers that surround them (navigation, header, footer,
sidebar, notice, advert, form, comments). Pass two gives the short or doubtful blocks that
are left the label of their nearest decided neighbours. Inside a declared article or main
element the stop-word rule does not reject, since tables or lists of names are text there.
On a page whose language has no stop words here, marks of sentences stand in for them.

A null, empty or text-free page gives an empty text. Repeated rows stay apart, other columns
are ignored, and any length is read to its end. Unclosed tags end with their container,
head with the first element of the body; only script, style and textarea run on. Time grows
with the length of a page, also where tags, quotes or elements are never closed.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import map_rows

# Frequent function words of the supported languages.
STOP_WORDS = frozenset(
    """
    a an and are as at be by for from has have he her his in is it its not of on or she that the
    their they this to was were which with you
    au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous on ou par pas
    pour qui que sa se ses son sur un une vous
    als am auch auf aus bei das dem den der des die ein eine einem einen einer er es für im in ist
    mit nach nicht oder sich sie sind so und von wie zu zum zur
    al como con cuando del el ella en entre era es esta este fue ha la las lo los mas más muy no o
    para pero por que se si sin su sus un una y
    """.split()
)
# Elements whose content is never text, containers, and elements that end a block.
SILENT = frozenset("noscript template select button svg iframe object title head canvas option datalist".split())
# What runs on without its end tag, whatever stands in it, and what may stand in head.
RAW = frozenset("script style textarea".split())
HEAD = frozenset("title meta link base basefont script style noscript template".split())
REJECTED = frozenset("nav header footer aside form menu dialog".split())
DECLARED = frozenset("article main".split())
CONTAINERS = REJECTED | DECLARED | frozenset("div section ul ol dl table tbody thead tr td th figure figcaption fieldset details blockquote body html center".split())
BLOCKS = CONTAINERS | frozenset("p li dt dd h1 h2 h3 h4 h5 h6 pre address hr caption summary legend".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HINTS = frozenset(
    """
    ad ads adv advert adverts advertisement advertising adsense banner promo promoted promotion
    sponsor sponsored sponsors sidebar side rail nav navbar navigation menu breadcrumb breadcrumbs
    footer header masthead comment comments commentlist reply replies respond disqus discussion
    cookie cookies notice consent gdpr newsletter subscribe subscription signup login popup modal
    overlay share sharing social related recommended recommendations widget toolbar pagination
    pager copyright legal disclaimer alert skip
    """.split()
)
# Parts that beside hints say where a container lies or what it looks like.
NEUTRAL = frozenset(
    """
    site page main global local primary secondary top bottom left right upper lower inner outer
    area box bar block section wrapper wrap container list item items content links link buttons
    button icons posts post form text body message modal col column slot unit widget region zone
    """.split()
)
TEXT_HINTS = frozenset("article articlebody post entry story".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog note menu menubar toolbar".split())

#: Characters below which a block is short, and above which one stop-word rich block is text.
SHORT, LONG = 70, 200
#: Share of stop words that marks text, and below which a longer block is none.
RICH, POOR = 0.30, 0.12
#: Share of stop words in all longer blocks below which the page's language is not listed.
UNLISTED = 0.05
#: Share of characters inside links that marks navigation.
LINKED = 0.5

_START = re.compile(r"<!--|<!\[CDATA\[|<[!?]|</?(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)", re.IGNORECASE)
_QUOTED_END = re.compile(r"(?>[^\"'>]+|\"[^\"]*\"|'[^']*')*+>")
_QUOTE_OR_END = re.compile(r"[\"'>]")
_RAW_ENDS = {name: re.compile(rf"</{name}\s*+>", re.IGNORECASE) for name in RAW}
_TITLE_ENDS = re.compile(r"(?P<end></title\s*+>)|</?(?:head|body)\b", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"(?<![a-zA-Z:-])([a-zA-Z:-]++)\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|\b(hidden)\b", re.IGNORECASE)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_CORE = re.compile(r"\w(?:.*\w)?", re.DOTALL)
# Marks that end or divide sentences, and scripts whose letters stand for more than one.
_SENTENCE = re.compile(r"[.!?](?=\s|$)|[。！？।॥؟۔։።…]")
_CLAUSE = re.compile(r"[,;:](?=\s|$)|[，、；：،؛]")
_DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


@dataclass
class Block:
    text: str
    linked: int
    rejected: bool
    declared: int
    heading: bool
    hinted: int = 0  # innermost container around it that only its name rejects


def _is_hint(token: str) -> bool:
    """Whether a whole class token names what is no article text, as in left-sidebar but not no-sidebar."""
    parts = [p.lower() for p in _NAME_PARTS.findall(token)]
    return any(p in HINTS for p in parts) and all(p in HINTS or p in NEUTRAL or p.isdigit() for p in parts)


def _named(attributes: str) -> bool:
    """Whether class or id of a tag names what is no article text."""
    found = ((name.lower(), value.strip("\"'")) for name, value, _ in _ATTRIBUTE.findall(attributes))
    return any(name in ("class", "id") and any(map(_is_hint, value.split())) for name, value in found)


def _hinted(attributes: str) -> bool:
    """Whether role or visibility of a tag marks what is no article text."""
    for name, value, hidden in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if hidden or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return True
    return False


def _declares_text(attributes: str) -> bool:
    """Whether a container is named as the place of the article."""
    for name, value, _ in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "itemprop" and value.lower() == "articlebody" or name == "role" and value.lower() in ("main", "article"):
            return True
        if name in ("class", "id") and any(p.lower() in TEXT_HINTS for p in _NAME_PARTS.findall(value)):
            return True
    return False


def _declares_main(tag: str, attributes: str) -> bool:
    """Whether a tag is the one place of the article; teasers and comments may be article elements too."""
    if tag == "main":
        return True
    found = ((name.lower(), value.strip("\"'").lower()) for name, value, _ in _ATTRIBUTE.findall(attributes))
    return any((name, value) in (("itemprop", "articlebody"), ("role", "main")) for name, value in found)


class _Tags:
    """Tags of a page in order: start, end, name (empty: none) and attributes.

    Where quotes of a tag are never closed it ends at the next ``>``. All ends of such a page
    are settled in one pass backwards, so that no tag looks at the rest of the page again.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = page.rfind(">")
        self.no_title = 0  # before this place a title has no end
        self.marks: list[int] | None = None

    def __iter__(self) -> Iterator[tuple[int, int, str, str]]:
        page, look = self.page, 0
        while found := _START.search(page, look):
            start, opened = found.span()
            name = (found["tag"] or "").lower()
            if not name:
                end = self._end_of_other(found.group(), opened)
            else:
                end = self._end_of_tag(opened)
            if end is None:
                look = opened
                continue
            attributes = page[opened : end - 1] if name else ""
            if name in RAW and page[start + 1] != "/":
                closed = _RAW_ENDS[name].search(page, end)
                end, name = (closed.end() if closed else len(page)), ""
            elif name == "title" and page[start + 1] != "/" and not attributes.endswith("/") and end > self.no_title:
                closed = _TITLE_ENDS.search(page, end)
                if closed and closed["end"]:
                    end, name = closed.end(), ""
                else:
                    self.no_title = closed.start() if closed else len(page)
            yield start, end, name, attributes
            look = end

    def _end_of_other(self, opening: str, at: int) -> int | None:
        closing = {"<!--": "-->", "<![CDATA[": "]]>"}.get(opening.upper())
        if closing:
            end = self.page.find(closing, at)
            return len(self.page) if end < 0 else end + len(closing)
        return self.page.find(">", at) + 1 if at <= self.last else None

    def _end_of_tag(self, at: int) -> int | None:
        if at > self.last:
            return None
        if self.marks is None:
            found = _QUOTED_END.match(self.page, at)
            if found:
                return found.end()
            self._settle(at)
        k = bisect_left(self.marks, at)
        return self.ends[k] or self.plain[k]

    def _settle(self, at: int) -> None:
        """For every later quote and ``>``: where a tag that comes to it ends (0: never)."""
        page = self.page
        self.marks = [m.start() for m in _QUOTE_OR_END.finditer(page, at)]
        self.ends, self.plain = [0] * (len(self.marks) + 1), [0] * (len(self.marks) + 1)
        following: dict[str, int] = {}
        for k in range(len(self.marks) - 1, -1, -1):
            mark = page[self.marks[k]]
            if mark == ">":
                self.ends[k] = self.plain[k] = self.marks[k] + 1
            else:
                self.ends[k] = self.ends[following[mark] + 1] if mark in following else 0
                self.plain[k] = self.plain[k + 1]
                following[mark] = k


class _Open:
    """Stack of open elements that knows the innermost place of each name."""

    def __init__(self, first: tuple) -> None:
        self.rows = [first]
        self.places: dict[str, list[int]] = {}

    def __len__(self) -> int:
        return len(self.rows)

    def push(self, row: tuple) -> None:
        self.places.setdefault(row[0], []).append(len(self.rows))
        self.rows.append(row)

    def place(self, name: str) -> int:
        """The innermost place of a name, 0 if it is not open."""
        found = self.places.get(name)
        return found[-1] if found else 0

    def cut(self, place: int) -> None:
        while len(self.rows) > place:
            self.places[self.rows.pop()[0]].pop()


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order, with the evidence that pass one needs.

    The name of a container does not reject it if it holds the main region of the page, or,
    where none is declared outside of it, most of the text and of what is rich in stop words.
    """
    parents: list[int] = [0]  # of containers that only their name rejects, the outer one of each
    main_in: set[int] = set()
    found = list(_blocks(page, parents, main_in))
    if not any(b.hinted for b in found):
        return found
    rich = [len(b.text) if not b.rejected and len(b.text) >= SHORT and _density(b.text) >= RICH else 0 for b in found]
    whole = [0 if b.rejected else len(b.text) for b in found]
    count = len(parents)
    held_rich, held_whole, holds_main = [0] * count, [0] * count, [k in main_in for k in range(count)]
    for b, some, every in zip(found, rich, whole, strict=True):
        held_rich[b.hinted] += some
        held_whole[b.hinted] += every
    for k in range(count - 1, 0, -1):
        held_rich[parents[k]] += held_rich[k]
        held_whole[parents[k]] += held_whole[k]
        holds_main[parents[k]] |= holds_main[k]
    all_rich, all_whole = sum(rich), sum(whole)
    around_main, free = [True] * count, [True] * count
    for k in range(1, count):
        around_main[k] = holds_main[k] and around_main[parents[k]]
    outside = any(size and b.declared and around_main[b.hinted] for b, size in zip(found, rich, strict=True))
    for k in range(1, count):
        most = not outside and 2 * held_rich[k] > all_rich and 2 * held_whole[k] > all_whole
        free[k] = (holds_main[k] or most) and free[parents[k]]
    for b in found:
        b.rejected = b.rejected or not free[b.hinted]
    return found


def _blocks(page: str, parents: list[int], main_in: set[int]) -> Iterator[Block]:
    """Blocks in order; adds hinted containers to ``parents``, and to ``main_in`` those around the main region."""
    # Name, rejected, declared region, innermost container that its name rejects.
    open_tags = _Open(("", False, 0, 0))
    pieces: list[str] = []
    linked = regions = links = 0
    own_rejected = heading = False
    at = 0
    silent = _Open(("", 0))  # open silent elements, and the containers open around each

    def block() -> Iterator[Block]:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            _, rejected, declared, hinted = open_tags.rows[-1]
            yield Block(text, linked, rejected or own_rejected, declared, heading, hinted)
        pieces.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and len(silent) == 1:
            pieces.append(html.unescape(raw) if "&" in raw else raw)
            if links:
                linked += len("".join(pieces[-1].split()))

    for start, end, tag, attributes in _Tags(page):
        say(page[at:start])
        at = end
        if not tag:
            continue
        closing = page[start + 1] == "/"
        inside = silent.rows[-1][0]
        if silent.place("head") == 1 and (tag == "body" or inside == "head" and tag not in HEAD | {"head", "html"}):
            silent.cut(1)
        if tag in SILENT:
            if closing:
                silent.cut(silent.place(tag) or len(silent))
            elif not attributes.rstrip().endswith("/"):
                silent.push((tag, len(open_tags)))
            continue
        if len(silent) > 1:
            opened = open_tags.place(tag) if closing else 0
            if not closing or opened >= silent.rows[-1][1]:  # inside of the silent element
                if tag in CONTAINERS and closing:
                    open_tags.cut(opened)
                elif tag in CONTAINERS and not attributes.endswith("/"):
                    open_tags.push((tag, *open_tags.rows[-1][1:]))
                continue
            if not opened:
                continue
            while len(silent) > 1 and silent.rows[-1][1] > opened:
                silent.cut(len(silent) - 1)
            if len(silent) > 1:
                open_tags.cut(opened)
                continue
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            pieces.append(" ")
        if tag not in BLOCKS:
            continue
        yield from block()
        links, own_rejected, heading = 0, False, False
        if tag not in CONTAINERS:
            if not closing and tag not in VOID:
                own_rejected = bool(attributes) and (_hinted(attributes) or _named(attributes))
                heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        elif closing:
            open_tags.cut(open_tags.place(tag) or len(open_tags))
        elif not attributes.endswith("/"):
            _, rejected, declared, hinted = open_tags.rows[-1]
            declares = tag in DECLARED or _declares_text(attributes)
            if not rejected and not declared and declares:
                regions += 1
                declared = regions
            if not rejected and hinted and _declares_main(tag, attributes):
                main_in.add(hinted)
            inner_header = tag == "header" and declared
            rejected = rejected or (tag in REJECTED and not inner_header)
            if tag not in ("body", "html") and attributes:
                rejected = rejected or _hinted(attributes)
                if not declares and not inner_header and _named(attributes):
                    parents.append(hinted)
                    hinted = len(parents) - 1
            open_tags.push((tag, rejected, declared, hinted))
    say(page[at:])
    yield from block()


def _stop_words(text: str) -> tuple[int, int]:
    """How many words are stop words, and how many there are."""
    words = text.lower().split()
    cores = map(_CORE.search, words)
    return sum(core is not None and core.group() in STOP_WORDS for core in cores), len(words)


def _density(text: str) -> float:
    stops, words = _stop_words(text)
    return stops / words


def _is_navigation(b: Block) -> bool:
    return b.linked > LINKED * len("".join(b.text.split()))


def _is_unlisted(found: list[Block]) -> bool:
    """Whether the longer blocks of a page hardly use any stop word of the lists."""
    longer = [b.text for b in found if not b.rejected and _size(b.text) >= SHORT and not _is_navigation(b)]
    counts = list(map(_stop_words, longer))
    return bool(counts) and sum(s for s, _ in counts) < UNLISTED * sum(n for _, n in counts)


def _size(text: str) -> int:
    """Length of a text; ideographs, kana and Hangul count as three letters."""
    return len(text) + (0 if text.isascii() else 2 * len(_DENSE.findall(text)))


def _first_pass(b: Block, unlisted: bool) -> tuple[bool | None, bool]:
    """Label if decided, and whether a doubtful block leans to text."""
    size = _size(b.text) if unlisted else len(b.text)
    if b.rejected:
        return False, False
    if _is_navigation(b):
        return False, False
    if size < SHORT:
        return None, b.heading and bool(b.declared)
    if b.declared:
        return True, True
    if unlisted:
        if _SENTENCE.search(b.text):
            return (True, True) if size > LONG else (None, True)
        return (None, False) if _CLAUSE.search(b.text) else (False, False)
    density = _density(b.text)
    if density >= RICH:
        return (True, True) if size > LONG else (None, True)
    if density < POOR:
        return False, False
    return None, density >= (RICH + POOR) / 2


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by one line end."""
    found = blocks(page or "")
    unlisted = _is_unlisted(found)
    decided = [_first_pass(b, unlisted) for b in found]
    labels = [label for label, _ in decided]
    kept = []
    before = _nearest(labels, found, range(len(found)))
    after = _nearest(labels, found, range(len(found) - 1, -1, -1))
    for k, b in enumerate(found):
        label = labels[k]
        if label is None:
            (near, left), (far, right) = before[k], after[k]
            if left is None and right is None:
                label = bool(b.declared) or decided[k][1]
            elif left is None or right is None or left == right:
                label = bool(right if left is None else left) or bool(b.declared)
            elif decided[k][1]:
                label = True
            elif near == far:
                label = bool(b.declared)
            else:
                label = bool(left if near < far else right)
        if label:
            kept.append(b.text)
    return "\n".join(kept)


def _nearest(labels: list[bool | None], found: list[Block], order: range) -> list[tuple[int, bool | None]]:
    """For each block, distance and label of the last decided one in this direction.

    Blocks of rejected containers say nothing about what stands beside the container.
    """
    out: list[tuple[int, bool | None]] = [(0, None)] * len(found)
    last: dict[int, tuple[int, bool]] = {}
    for k in order:
        region = found[k].declared
        at, label = last.get(region, (k, None))
        out[k] = abs(k - at), label
        if labels[k] is not None and not found[k].rejected:
            last[region] = k, labels[k]
    return out


def extract(pages: DataFrame, html_column: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Keys of each page with its main text and the text's length in code points."""

    def start():
        def rows(*values):
            text = main_text(values[-1])
            yield (*values[:-1], text, len(text))

        return rows

    frame = pages.select(*keys, F.col(html_column).cast("string"))
    types = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    return map_rows(frame, start, f"{types}, text string, n_chars long")
