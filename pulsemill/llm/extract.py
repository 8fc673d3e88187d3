"""Main text of HTML pages: the best-scoring run of blocks.

A page is read as a sequence of blocks of words with tags between them. Words score
positive or negative by the kind of block they stand in, tags score negative, and one linear
scan finds the contiguous run of blocks with the largest sum. The weights are log odds
counted on labelled pages: pages whose author has marked the content (article or main), of
which at most about ``TRAIN`` are read; kinds of block that these do not show keep their
prior. Elements that are never article text (menus, forms, adverts, reader comments, ...)
are cut out of the run by name, unless they hold the article.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsemill.llm import words as W

#: labelled pages that weights are counted on, about
TRAIN = 2000
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre "
    "search section summary table tbody tfoot thead title tr ul".split()
)
#: cells of a row, which is a block: white space stands between them
CELLS = frozenset(("td", "th"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose text is no part of an article
NEVER = frozenset(
    "applet audio aside button canvas datalist dialog footer head iframe input map menu nav noscript object script "
    "search select style svg template textarea title video".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: words of a class or id that say an element is not the article
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adsense sponsor sponsored sponsors promo promoted promotion "
    "nav navbar navigation navi menu menus breadcrumb breadcrumbs sidebar sidebars aside footer foot masthead topbar "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox newsletter subscribe "
    "subscription signup login signin register share sharing social related recommended recommendations comment comments "
    "commentlist disqus replies respond discussion toolbar pagination pager banner copyright skip paywall".split()
)
#: those of them that name readers' comments: they do not cut an element that holds all of the
#: page's h1, article and main elements, or, if it has none, most of its words; others, and
#: ``form``, do not cut one that holds any of these, or most of the words: over ``MOST_CUT``
FIRM = frozenset("comment comments commentlist disqus replies".split())
MOST_CUT = 0.6
#: those of them that are topics of articles as well: alone, inside marked content, they cut
#: only an element that is made of links and comments, or a label of under ``LABEL`` words
TOPICS = frozenset(
    "discussion respond related register notice notices share sharing social sponsor sponsors promotion navigation "
    "cookie cookies consent gdpr notification alert subscribe subscription recommended recommendations copyright".split()
)
LABEL = 10
#: how an element is named as no article
SURE, COMMENTS, PERHAPS, TOPIC = range(4)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CONTENT = frozenset(("article", "main"))
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: opening one of these ends an open p
_ENDS_P = BLOCKS - {"option", "optgroup", "body", "html", "head", "title", "legend", "caption", "tbody", "tfoot", "thead", "tr", "li", "dd", "dt"} | {"li", "dd", "dt"}
_SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr"}, "option": {"option"}}


@dataclass
class Block:
    tag: str = "body"
    parts: list[str] = field(default_factory=list)
    links: int = 0
    tags: list[str] = field(default_factory=list)  # between the block before and this one, and in it
    inside: bool = False  # in an article or main element
    within: int = -1  # the innermost element around it that is named as no article
    cut: bool = False

    @property
    def words(self) -> list[str]:
        return "".join(self.parts).split()


#: elements nested deeper become siblings, as in browsers
DEEPEST = 512
#: words before a name that speak of the page's layout: no-sidebar, has-sidebar
_OF_LAYOUT = frozenset("no non not without has have with".split())


class _Parser(HTMLParser):
    """Reads what is not well formed as browsers do; the whole page is fed at once.

    An open comment or tag at the end takes the rest of the page; ``<![...>`` other than a closed
    CDATA section is a comment that ends at the next ``>``.
    """

    def parse_comment(self, i: int, report: int = 1) -> int:
        page = self.rawdata
        if page.startswith(("<!-->", "<!--->"), i):
            return page.index(">", i) + 1
        at = page.find("-->", i + 4)
        return len(page) if at < 0 else at + 3

    def parse_html_declaration(self, i: int) -> int:
        page = self.rawdata
        if page.startswith("<!--", i):
            return self.parse_comment(i)
        if page.startswith("<![CDATA[", i) and (at := page.find("]]>", i)) >= 0:
            return at + 3
        at = page.find(">", i)
        return len(page) if at < 0 else at + 1

    def parse_starttag(self, i: int) -> int:
        return len(self.rawdata) if self.rawdata.find(">", i) < 0 else super().parse_starttag(i)

    def parse_endtag(self, i: int) -> int:
        return len(self.rawdata) if self.rawdata.find(">", i) < 0 else super().parse_endtag(i)

    def parse_pi(self, i: int) -> int:
        return len(self.rawdata) if self.rawdata.find(">", i) < 0 else super().parse_pi(i)


class _Page(_Parser):
    """Turns a page into blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, int]] = []  # open elements: name, and number if named as no article
        self.around: list[tuple[str, int]] = [("body", -1)]  # at each: the innermost block and number
        self.open: Counter = Counter()  # open elements by name
        self.named: list[int] = []  # how the element of this number is named as no article
        self.outer: list[int] = []  # and the number of the next one around it; outer ones come first
        self.marks: list[tuple[str, int]] = []  # h1, article and main elements, and the number around them
        self.replies: set[int] = set()  # numbers of elements in an article that hold articles of their own
        self.content = self.links = 0
        self.labelled = False
        self._new()

    def _new(self) -> None:
        tag, within = self.around[-1]
        last = self.blocks[-1] if self.blocks else None
        if last is not None and not last.parts:  # nothing was said in it
            last.tag, last.within, last.inside = tag, within, self.content > 0
            return
        self.blocks.append(Block(tag, inside=self.content > 0, within=within))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _ENDS_P and any(t == "p" for t, _ in self.stack[-8:]):
            self._close("p")
        if tag in _SIBLINGS and self.stack and self.stack[-1][0] in _SIBLINGS[tag]:
            self._close(self.stack[-1][0])
        if tag in VOID:
            if tag == "br":
                self.blocks[-1].parts.append(" ")
            elif tag == "hr":
                self._new()
            self.blocks[-1].tags.append(tag)
            return
        if len(self.stack) >= DEEPEST:
            self._pop()
        number, how = -1, self._no_article(tag, dict(attrs))
        if tag == "article":
            if self.open["article"]:
                outer = next(i for i, (t, _) in enumerate(self.stack) if t == "article")
                self.replies.update(n for _, n in self.stack[outer:] if n >= 0)
        if how is not None:
            number = len(self.named)
            self.named.append(how)
            self.outer.append(self.around[-1][1])
        elif tag in CONTENT or tag == "h1":
            self.marks.append((tag, self.around[-1][1]))
        self.stack.append((tag, number))
        self.open[tag] += 1
        block, within = self.around[-1]
        self.around.append((tag if tag in BLOCKS else block, number if number >= 0 else within))
        if tag in CONTENT and number < 0:
            self.content += 1
            self.labelled = True
        self.links += tag == "a"
        if tag in BLOCKS or number >= 0:
            self._new()
        elif tag in CELLS:
            self.blocks[-1].parts.append(" ")
        self.blocks[-1].tags.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag not in VOID and self.open[tag] > 0:
            self._close(tag)
            self.blocks[-1].tags.append(tag)

    def _close(self, tag: str) -> None:
        block = False
        while self.stack:
            name, number = self._pop()
            block |= name in BLOCKS or number >= 0
            if name == tag:
                break
        if block:
            self._new()
        elif tag in CELLS:
            self.blocks[-1].parts.append(" ")

    def _pop(self) -> tuple[str, int]:
        name, number = self.stack.pop()
        self.around.pop()
        self.open[name] -= 1
        self.content -= name in CONTENT and number < 0
        self.links -= name == "a"
        return name, number

    def handle_data(self, data: str) -> None:
        self.blocks[-1].parts.append(data)
        if self.links > 0:
            self.blocks[-1].links += len(data.split())

    def _no_article(self, tag: str, attrs: dict[str, str | None]) -> int | None:
        """How an element is named as no article: for sure, or otherwise, or (None) not at all."""
        role = attrs.get("role") or ""
        if tag in NEVER or "hidden" in attrs or attrs.get("aria-hidden") == "true" or role in ROLES:
            return SURE
        if "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
            return SURE
        if tag == "header":
            return None if self.content else SURE
        if tag in ("html", "body", "main") or tag in HEADINGS:
            return None
        given = [_NAME.findall(name) for key in ("class", "id") for name in (attrs.get(key) or "").split()]
        names = {w.lower() for words in given if words and words[0].lower() not in _OF_LAYOUT for w in words} & NAMES
        if names & FIRM:
            return COMMENTS
        if tag == "form" or role == "form":
            return PERHAPS
        if self.content and tag not in CONTENT and len(names) == 1 and names <= TOPICS:
            return TOPIC
        return PERHAPS if names else None


def _spread(page: _Page, cut: set[int]) -> list[bool]:
    """Which numbers are in ``cut`` or inside one that is; the last entry is for no number."""
    out = [False] * (len(page.named) + 1)
    for n, outer in enumerate(page.outer):
        out[n] = n in cut or out[outer]
    return out


def _sums(page: _Page, found: Iterable[tuple[int, int]]) -> list[int]:
    """Sums of (number, amount) per number and the numbers inside; the last entry is the sum of all."""
    out = [0] * (len(page.named) + 1)
    for n, amount in found:
        out[n] += amount
    for n in reversed(range(len(page.named))):
        out[page.outer[n]] += out[n]
    return out


def _cut(page: _Page) -> set[int]:
    """Numbers of the elements that are cut out of a page."""
    named = page.named
    cut = {n for n, how in enumerate(named) if how == SURE}
    if len(cut) == len(named):
        return cut
    gone = _spread(page, cut)
    texts = [(b, n) for b in page.blocks if not gone[b.within] and (n := len(b.words))]

    def most() -> set[int]:
        gone = _spread(page, cut)
        size = _sums(page, ((b.within, n) for b, n in texts if not gone[b.within]))
        return {n for n in range(len(named)) if size[n] > MOST_CUT * size[-1]}

    shown = [(tag, around) for tag, around in page.marks if not gone[around]]
    total, large = {tag for tag, _ in shown}, most()
    inside = {tag: _sums(page, ((around, 1) for t, around in shown if t == tag)) for tag in total}
    for e in (n for n, how in enumerate(named) if how == COMMENTS):
        other = {tag for tag in total if inside[tag][e] < inside[tag][-1]}
        any_mark = any(inside[tag][e] for tag in total)
        whole = ("main" in total and inside["main"][e]) or (any_mark and not other & {"h1", "article"}) or (e in large and not other)
        if not whole:
            cut.add(e)
    large = most()
    holds = _sums(page, ((around, 1) for _, around in page.marks))
    titled = _sums(page, ((around, 1) for tag, around in page.marks if tag == "h1"))
    cut |= {n for n, how in enumerate(named) if how == PERHAPS and not holds[n] and n not in large}
    texts_of: dict[int, list[tuple[Block, int]]] = {n: [] for n, how in enumerate(named) if how == TOPIC}
    for b, n in texts if texts_of else ():
        e = b.within
        while e >= 0:
            if e in texts_of:
                texts_of[e].append((b, n))
            e = page.outer[e]
    for e, own in reversed(texts_of.items()):  # inner ones first
        gone = _spread(page, cut)
        size = sum(n for _, n in own)
        other = sum(n if gone[b.within] else min(b.links, n) for b, n in own)
        label = size < LABEL and not any(b.tag in HEADINGS or b.tag in ("p", "section") for b, _ in own)
        if (e in page.replies and not titled[e]) or (not holds[e] and (2 * other > size or label)):
            cut.add(e)
    return cut


def blocks_of(html: str) -> tuple[list[Block], bool]:
    """The page's blocks with words, and whether its author marked the content."""
    page = _Page()
    page.feed(html)
    page.close()
    gone = _spread(page, _cut(page))
    found, pending = [], []
    for b in page.blocks:
        if "".join(b.parts).strip():
            b.tags = pending + b.tags
            pending = []
            b.cut = gone[b.within]
            found.append(b)
        else:
            pending += b.tags
    return found, page.labelled


def kind(block: Block, n: int) -> str:
    """What decides a word's weight: the block's tag, its length, and whether it is mostly links or cut out."""
    tag = "h" if block.tag in HEADINGS else block.tag if block.tag in BLOCKS else "other"
    size = 0 if n < 4 else 1 if n < 10 else 2 if n < 25 else 3
    return f"{tag} {size} {int(2 * block.links > n)} {int(block.cut)}"


def _prior(name: str) -> float:
    """Log odds of a kind of block that labelled pages do not show."""
    tag, size, links, cut = name.split()
    if cut == "1":
        return -3.0
    return (-0.2, 0.3, 1.0, 1.5)[int(size)] + (1.0 if tag in ("p", "h", "pre", "blockquote") else 0.0) - 2.0 * (links == "1")


#: what a tag costs at least and at most, and words that the prior counts for
LEAST_COST, MOST_COST, PRIOR_WORDS = 0.05, 2.0, 20.0
#: the score of a block that is cut out anyway
CUT_COST = -0.5


def tally(html: str) -> Counter:
    """(what, name, inside) -> words or tags of a labelled page; nothing for another page."""
    found: Counter = Counter()
    blocks, labelled = blocks_of(html)
    if labelled:
        for b in blocks:
            n, good = len(b.words), b.inside and not b.cut
            found["w", kind(b, n), good] += n
            for t in b.tags:
                found["t", t if t in BLOCKS or t in ("a", "b", "i", "em", "strong", "span", "br", "img") else "other", good] += 1
    return found


def weights(counts: dict[tuple[str, str, bool], int]) -> dict[str, float]:
    """Weight per kind of block and per tag."""
    out = {}
    for what, name in {(w, n) for w, n, _ in counts}:
        good, bad = counts.get((what, name, True), 0), counts.get((what, name, False), 0)
        if what == "w":
            p = 1 / (1 + math.exp(-_prior(name)))
            out[f"w {name}"] = math.log((good + PRIOR_WORDS * p) / (bad + PRIOR_WORDS * (1 - p)))
        else:
            out[f"t {name}"] = -min(MOST_COST, max(LEAST_COST, math.log((bad + 1) / (good + 1))))
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the largest sum; empty if nothing is positive. The
    first and longest of equal ones."""
    best, at = 0.0, (0, 0)
    total, start = 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > 0 and (total > best or (total == best and start == at[0])):
            best, at = total, (start, i + 1)
    return at


def main_text(html: str, model: dict[str, float]) -> str:
    """The text of the best run: blocks without what is cut out, white space as single spaces, joined by an empty line."""
    blocks, labelled = blocks_of(html)
    scores, texts = [], []
    for b in blocks:
        words = b.words
        name = kind(b, len(words))
        each = model.get(f"w {name}", _prior(name))
        if labelled:  # the author says where the content is
            each = max(each, 1.0) if b.inside else min(each, -1.0)
        cost = sum(model.get(f"t {t}", -LEAST_COST) for t in b.tags if t not in CONTENT)
        if b.cut:  # left out later; it need not end a run
            scores.append(CUT_COST)
        elif b.inside:  # tags cost less than any marked word brings
            scores.append(max(each * len(words) + cost, -CUT_COST))
        else:
            scores.append(each * len(words) + cost)
        texts.append("" if b.cut else " ".join(words))
    start, stop = best_run(scores)
    return "\n\n".join(t for t in texts[start:stop] if t)


def train(pages: DataFrame, *, sample: int = TRAIN, html: str = "html") -> dict[str, float]:
    """Weights from the different labelled pages with the smallest hashes, ``sample`` of them at least
    if there are as many; ``sample`` hashes and one row per kind come to the driver.

    What has the tag in a comment or a cut element is no labelled page; then more hashes are taken.
    """
    tagged = pages.select(F.col(html).alias("html")).where(F.col("html").rlike(r"(?i)<(article|main)[\s/>]"))
    tagged = tagged.withColumn("h", F.xxhash64("html"))
    least = [r["h"] for r in tagged.select("h").distinct().orderBy("h").limit(max(1, sample)).collect()]
    low, high = -(1 << 63), (1 << 63) - 1
    upto = least[-1] if len(least) >= max(1, sample) else high
    while True:
        counts = _tallied(tagged.where(F.col("h") <= upto).dropDuplicates(["h"]).select("html"))
        labelled = counts.pop(("p", "", True), 0)
        if labelled >= sample or upto >= high:
            return weights(counts)
        times = 1 + min(3.0, 1.2 * sample / max(1, labelled) - 1)
        upto = min(high, low + int((upto - low + 1) * times))


def _tallied(picked: DataFrame) -> dict[tuple[str, str, bool], int]:
    """The sums of all pages' tallies, and under ("p", "", True) how many are labelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for h in batch.column("html").to_pylist():
                found = tally(h)
                total.update(found)
                total["p", "", True] += bool(found)
            what, name, good = zip(*total, strict=True) if total else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(what, pa.string()), pa.array(name, pa.string()), pa.array(good, pa.bool_()), pa.array(total.values(), pa.int64())],
                ["what", "name", "good", "n"],
            )

    found = picked.repartition(16).mapInArrow(run, "what string, name string, good boolean, n long").groupBy("what", "name", "good").agg(F.sum("n").alias("n"))
    return {(r["what"], r["name"], r["good"]): r["n"] for r in found.collect()}


def extract(pages: DataFrame, model: dict[str, float], *, html: str = "html") -> DataFrame:
    """``pages`` without the html column, with ``text`` and ``n_chars``, its code points.

    A null or empty page, and one without a positive run, has the empty text. Rows are
    independent of each other, so repeated pages get equal texts; columns named like the
    results are replaced and others pass through.
    """
    kept = [c for c in pages.columns if c not in ("text", "n_chars", html)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, "_html"):
            texts = [main_text(h, model) if h else "" for h in part.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*kept, "text", "n_chars"],
            )

    given = pages.select(*kept, F.col(html).alias("_html"))
    return given.mapInArrow(run, pages.select(*kept).schema.add("text", "string").add("n_chars", "long"))
