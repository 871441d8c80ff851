"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import prepare

# Function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be because been before but by can could did do does for from had has have he her him his how i if in into is it its
    just like more most my no not of on one only or other our out over said she so some such than that the their them then there these they this those to up was we
    were what when which who will with would you your
    aber als am an auch auf aus bei bin bis da dann das dass dein dem den der des die dies diese dieser du durch ein eine einem einen einer eines er es euch für hat
    haben hatte ich ihm ihn ihr im in ist ja kann kein man mehr mein mich mir mit nach nicht noch nun nur ob oder ohne sein seine sich sie sind so über um und uns
    unter vom von vor war waren was weil wenn wer werden wie wieder wird wir wo zu zum zur
    ai au aux avec avait bien ce ces cette comme dans de des deux du elle en est et été être fait il ils je la le les leur lui mais me même mes moi mon ne nos
    notre nous on ont ou où par pas plus pour qu que qui sa sans se ses si son sont sous sur ta te tes toi ton tous tout très tu un une vos votre vous y
    al algo como con contra cual cuando de del desde donde durante e el ella ellos en entre era es esa ese eso esta este esto estos fue ha hasta hay la las le les
    lo los más me mi mucho muy nada ni no nos o os otra otro para pero por porque que qué quien se ser si sin sobre son su sus también tanto te tiene todo todos
    un una uno unos y ya yo""".split()
)
_RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title")  # unclosed, they run to the end of the page
_DROPPED = frozenset((*_RAW, "svg", "object", "canvas", "select", "button", "audio", "video", "datalist"))
_EMPTY = ("svg", "canvas")  # may be closed in the tag itself
_CLOSING = {x: re.compile(rf"</{x}\s*>", re.I) for x in _DROPPED}
_MATH = "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation annotation-xml"
_INLINE = frozenset(f"a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr input meta link {_MATH}".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ASIDE = frozenset("nav header footer aside form menu dialog fieldset search".split())
_HINTS = re.compile(
    r"(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|popup|modal|overlay|nav\w*|menu\w*|breadcrumbs?|sidebar|widgets?|footer|header|masthead|comments?|disqus|repl(?:y|ies)|respond|share|sharing|social|related|recommended|newsletter|subscri\w*|login|signup|pagination|pager|toolbar|skiplink|copyright|legal|disclaimer)",
    re.I,
)
# What else the name of such a part is made of; with any other word it says what the text is about, as category-social does.
_PARTS = frozenset(
    """site page main global primary secondary top bottom left right upper lower inner outer fixed sticky mobile desktop wide full box list area section block bar row col
    column group wrap wrapper container holder region panel zone slot unit item items link links button buttons icon icons post posts entry article articles story stories content
    form field inline side skip google dfp js ui wp the my is new all large small thread body title""".split()
)
_HINT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Patterns are possessive and stop at the next angle bracket: none looks at a character many times.
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:\s++[^\s\"'<>=/]++(?:\s*+=\s*+(?:\"[^\"<>]*+\"|'[^'<>]*+'|[^\s\"'<>=`]++))?+)*+\s*+/?)>")
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*+)")
_VALUE = re.compile(r"=\s*+([\"'])")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_MAIN = frozenset(("article", "main"))
_BARS = 8  # one in another; a container so deep is barred if any of these is
_STEPS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_LATIN, _LETTER = re.compile(r"[A-Za-z\u00aa-\u024f\u1e00-\u1eff]"), re.compile(r"[^\W\d_]")


class Rules(NamedTuple):
    """Lengths in characters; densities are shares of words."""

    short: int = 70
    stop_low: float = 0.10
    stop_high: float = 0.18
    links: float = 0.33
    heading: int = 200
    page_low: float = 0.005  # of stop words in all that is left of a page none of whose blocks is good


class Block(NamedTuple):
    text: str
    linked: int  # characters inside links
    heading: bool
    barred: bool  # inside a menu, footer, advert, ...
    depth: int  # of how many containers it is in
    shared: int  # how many of them hold the block before, too
    main: bool


_ABOUT_PAGE = ("has-", "with-", "no-", "without-")  # names of layouts that have or lack a part


def _hint(name: str) -> str | None:
    """The part of a page that a class or id names, if it does."""
    if name.lower().startswith(_ABOUT_PAGE):
        return None
    words = _STEPS.findall(name)
    joined = "".join(words).lower()
    if joined in ("sidebar", "skiplink") or _HINTS.fullmatch(joined):
        return joined
    found = [w for w in words if _HINTS.fullmatch(w)]
    return found[0].lower() if found and all(w.lower() in _PARTS or w in found for w in words) else None


def _barred(tag: str, attributes: str, main: bool) -> bool:
    """Whether a container is named as something other than the article. Inside the article, headers are its own."""
    if tag in _ASIDE:
        return not (tag == "header" and main)
    if not attributes or len(attributes) < 4:
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            for word in value.split():
                hint = _hint(word)
                if hint and not (main and "header" in hint):
                    return True
        elif name == "role" and value.lower() in _HINT_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


class _Bar:
    """A container that its name, tag or role says is no article, and what it holds."""

    def __init__(self, tag: str) -> None:
        self.tag, self.text, self.holds = tag, 0, Counter()

    def lifted(self, text: int, all_: Counter[str]) -> bool:
        """Whether it holds what makes a page: its main element, all of its articles or headings with most of its text; a form, most text."""
        if self.tag in _MAIN and self.holds[self.tag] == all_[self.tag] or self.holds["main"]:
            return True
        most = 2 * self.text > text
        return most and (self.tag == "form" or any(self.holds[x] and self.holds[x] == all_[x] for x in ("article", "h1")))


class _Scanner:
    """Tags of a page in one pass. What is not there (a quote, the end of a comment) is looked for once."""

    def __init__(self, page: str) -> None:
        self.page, self.gone = page, set()

    def find(self, what: str, at: int) -> int:
        """Where it is next, -1 if it does not come any more."""
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def tag(self, at: int) -> tuple[int, bool, str, str]:
        """(end, closing, name, attributes) of what begins at ``at``; end is ``at`` for text, the name is empty for comments and the like."""
        page = self.page
        m = _TAG.match(page, at)
        if m:
            return m.end(), bool(m[1]), m[2].lower(), m[3]
        if page.startswith("<!--", at):
            end = self.find("-->", at + 4)
            return (len(page) if end < 0 else end + 3), False, "", ""
        m = _NAME.match(page, at)
        if not m:
            if page[at + 1 : at + 2] not in ("!", "?", "/") or len(page) == at + 1:
                return at, False, "", ""
            end = self.find(">", at)
            return (len(page) if end < 0 else end + 1), False, "", ""
        k = m.end()  # values in quotes may hold angle brackets
        while True:
            end = self.find(">", k)
            if end < 0:
                return len(page), page[at + 1] == "/", "", ""
            value = _VALUE.search(page, k, end)
            close = self.find(value[1], value.end()) if value else -1
            if close < 0:
                if value:
                    k = value.end()
                    continue
                return end + 1, page[at + 1] == "/", m[1].lower(), page[m.end() : end]
            k = close + 1


def blocks(page: str) -> list[Block]:
    """The page's blocks of text: runs between the tags of block elements. Bars are judged once all of the page is known."""
    scanner = _Scanner(page)
    stack: list[tuple[str, tuple[_Bar, ...], bool]] = []  # tag, what bars it, main
    found: list[tuple[Block, tuple[_Bar, ...]]] = []
    held: Counter[str] = Counter()
    total = 0
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    linked, in_link, heading, low = 0, False, False, 0

    def flush() -> None:
        nonlocal linked, parts, low, total
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                bars, main = (stack[-1][1], stack[-1][2]) if stack else ((), False)
                found.append((Block(text, min(linked, len(text)), heading, False, len(stack), min(low, len(stack)), main), bars))
                total += len(text)
                for b in bars:
                    b.text += len(text)
                low = len(stack)
        parts, linked = [], 0

    def close(k: int) -> None:
        nonlocal low
        open_tags.subtract(x[0] for x in stack[k:])
        del stack[k:]
        low = min(low, k)

    at = 0
    unclosed: set[str] = set()  # dropped elements that the rest of the page does not close
    while at < len(page):
        begin = page.find("<", at)
        if begin < 0:
            begin = len(page)
        end, closing, tag, attributes = scanner.tag(begin) if begin < len(page) else (begin, False, "", "")
        if end == begin < len(page):  # an angle bracket of the text
            end = begin + 1
            piece = page[at:end]
        else:
            piece = page[at:begin]
        if piece:
            parts.append(piece)
            if in_link:
                linked += len(piece.strip())
        at = end
        if not tag:
            continue
        if tag in _DROPPED:
            parts.append(" ")
            if not closing and not (tag in _EMPTY and attributes.endswith("/")) and tag not in unclosed:
                over = _CLOSING[tag].search(page, at)
                if over:
                    at = over.end()
                elif tag in _RAW:
                    at = len(page)
                else:
                    unclosed.add(tag)
            continue
        if tag == "a":
            in_link = not closing
            continue
        if tag in _INLINE:
            if tag in ("br", "img", "input"):
                parts.append(" ")
            continue
        flush()
        if closing:
            if open_tags[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
            heading = False
        elif tag not in _VOID:
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                close(len(stack) - 1)
            if tag not in ("p", "html", "body") and stack and stack[-1][0] == "p":
                close(len(stack) - 1)
            in_link = False
            up = stack[-1] if stack else ("", (), False)
            main = up[2] or tag in _MAIN
            bars = up[1]
            if len(bars) < _BARS and tag not in ("html", "body") and _barred(tag, attributes, up[2]):
                bars = (*bars, _Bar(tag))
            if tag in ("article", "main", "h1"):
                held[tag] += 1
                for b in bars:
                    b.holds[tag] += 1
            stack.append((tag, bars, main))
            open_tags[tag] += 1
            heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    flush()
    return [b._replace(barred=not all(x.lifted(total, held) for x in bars)) if bars else b for b, bars in found]


_WORD = re.compile(r"[^\W\d_]+")


def _share(text: str) -> float:
    """Of stop words among its words."""
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def classify(page: list[Block], rules: Rules) -> list[str]:
    """First pass, each block alone: good, near (some stop words), sparse (few), short or bad (links, or the name of its container)."""
    out = []
    for b in page:
        if b.barred or b.linked > rules.links * len(b.text) or "\xa9" in b.text and len(b.text) < rules.short and not b.main:
            out.append("bad")
        elif len(b.text) < rules.short:
            out.append("bad" if b.linked and not b.main else "short")
        else:
            share = _share(b.text)
            out.append("good" if share >= rules.stop_high else "near" if share >= rules.stop_low else "sparse")
    return out


def decide(page: list[Block], first: list[str], rules: Rules) -> list[bool]:
    """Second pass: ambiguous blocks take the label of the nearest decided neighbour.

    Nearest is fewest containers apart (those to be left or entered, without the innermost), then fewest characters;
    between equally near neighbours of different labels a block with some stop words is good, one with few or a short one
    is bad; outside an article or main that has good text, such blocks are bad. A heading shortly before good text is good. Decided are good and bad blocks; for short ones also the longer
    ambiguous ones, which this pass decides first. Where no block of the page is good by its words, those inside article or
    main are, unless bad, and without any all that are not bad, if taken together they have some stop words; where their letters
    are mostly of scripts other than Latin, those that are not short.
    """
    label = [x if x in ("good", "bad") else None for x in first]
    if "good" not in label:
        rest = [i for i, x in enumerate(first) if x != "bad"]
        inside = [i for i in rest if page[i].main]
        if not inside:
            text = " ".join(page[i].text for i in rest)
            if _share(text) >= rules.page_low:
                inside = rest
            elif 2 * len(_LATIN.findall(text)) < len(_LETTER.findall(text)):  # a script that the lists do not know: by length
                inside = [i for i in rest if first[i] != "short"]
        for i in inside:
            label[i] = "good"
    article = any(b.main and x == "good" for b, x in zip(page, label, strict=True))
    start, total = [], 0
    for b in page:
        start.append(total)
        total += len(b.text)

    def near(order: Iterable[int], step: int, decided: list[str | None]) -> list[tuple[int, int]]:
        """The decided block before (after) each one, and how many containers hold both."""
        out, last, shared = [(-1, 0)] * len(page), -1, 0
        for i in order:
            if last >= 0:
                shared = min(shared, page[i].shared if step > 0 else page[i + 1].shared)
            out[i] = last, shared
            if decided[i]:
                last, shared = i, page[i].depth
        return out

    for kinds, doubt in ((("near", "sparse"), {"near": "good", "sparse": "bad"}), (("short",), {"short": "bad"})):
        before, after = near(range(len(page)), 1, label), near(range(len(page) - 1, -1, -1), -1, label)
        new = list(label)
        for i, b in enumerate(page):
            if first[i] not in kinds or label[i]:
                continue
            found = []
            for j, shared in (before[i], after[i]):
                if j >= 0:
                    x, y = b.depth - 1, page[j].depth - 1
                    gap = start[i] - start[j] - len(page[j].text) if j < i else start[j] - start[i] - len(b.text)
                    found.append((x + y - 2 * min(shared, x, y), gap, label[j]))
            last = after[i][0]
            if not found or article and not b.main and first[i] != "near":
                new[i] = "bad"
            elif b.heading and last >= 0 and label[last] == "good" and found[-1][1] <= rules.heading and found[-1][0] <= 2:
                new[i] = "good"
            else:
                least = min(f[:2] for f in found)
                labels = {f[2] for f in found if f[:2] == least}
                new[i] = labels.pop() if len(labels) == 1 else doubt[first[i]]
        label = new
    return [x == "good" for x in label]


def extract(page: str | None, rules: Rules = Rules()) -> str:
    """The main text: good blocks in page order, joined by one space."""
    if not page:
        return ""
    found = blocks(page)
    return " ".join(b.text for b, good in zip(found, decide(found, classify(found, rules), rules), strict=True) if good)


def _extracting(rules: Rules) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([extract(x.as_py(), rules) for x in column], pa.string())

    return run


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: Rules = Rules()) -> DataFrame:
    """Returns a row per page: page_id, url, text (empty if none), n_chars (code points).

    Whole pages are read, markup broken or not. Null html counts as empty. Repeated rows, null ids or urls: a row each.
    Extra columns are ignored; an empty table gives an empty result.
    """
    prepare(pages.sparkSession)
    run = F.arrow_udf(_extracting(rules), "string")
    out = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), run(F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
