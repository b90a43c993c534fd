"""Main text of web pages by block rules in two passes.

A page is cut into blocks at the tags that end a line (paragraphs, headings,
list items, cells, two line breaks in a row, ...). The first pass decides each
block by itself: by the share of its characters inside links, its length, the
share of its words that are stop words of some language, and by what the page
says of the part that it stands in (menus, footers, forms, adverts, comments,
...). Blocks too short to tell stay open. In the second pass each run of open
blocks takes the label of its nearest decided neighbours: that of both where they
agree, else that of the nearer one. What an ``article`` or ``main`` element
holds has its neighbours in there, and open blocks are main text where such an
element decides nothing at all.

Markup is read as browsers read it: scripts, styles and comments that never end
take the rest of the page, character references are decoded once, unknown and
unclosed tags don't matter. A menu or footer that is never closed ends where the
next section or heading starts. All work is linear in the page.

A null or empty page gives an empty text, and so does one without main text.
Repeated rows give a row each. Only the columns named in ``keep`` are returned
beside the results; they may not be called ``text``, ``n_chars`` or ``n_blocks``.
An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RESULTS = ("text", "n_chars", "n_blocks")

#: A start or end tag; it fails only where the page ends inside of it.
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+)>")
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_COMMENT_END = re.compile(r"--!?>")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")

#: elements whose content is no markup
RAW = frozenset("script style title textarea xmp noembed noframes".split())
#: elements that stand inside a line
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements that are never main text, and those that aren't unless they stand in an article
NEVER = frozenset("nav footer aside form button select option fieldset dialog menu noscript iframe object svg math canvas audio video template head datalist".split())
OUTSIDE = frozenset("header hgroup address".split())
SECTIONS = frozenset("article main section nav aside footer header h1 h2 body".split())
ARTICLES = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: words of class and id names, and of roles, of parts that aren't main text
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert disclaimer popup modal overlay newsletter subscribe subscription signup login paywall nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc sidebar side aside widget widgets rail footer foot copyright masthead topbar header comment comments commentlist disqus reply replies responses share sharing social related recommended recommendations contentinfo complementary search form toolbar tags skip dialog alertdialog".split()
)
#: of them, those that an article can be itself
ARTICLE_PARTS = frozenset("ad ads advert advertisement sponsored promo comment comments reply related recommended teaser".split())
#: words of names: they end at a capital letter too
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: stop words of ten languages, and signs that do their work in scripts without spaces
STOP_WORDS = frozenset(
    """the of and to in is that for it was on are as with be this have from or by at not but which an they you
    der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er
    le la les de des et un une en que qui dans du pour pas sur par au est avec ce il plus sont
    el los las del y por con no una su para es al lo como más pero sus se
    il di che e per non sono con del della una da si nel
    o a os as um uma do dos em não para com
    het een van dat niet op te zijn voor met
    och att som en på det av för med
    и в не на что с по это как он но за к из
    i w na z do nie jest że się""".split()
)
_SIGNS = frozenset("的是在了和有不这の は を に が と で も 은 는 을 를 이 가".replace(" ", ""))
_NO_SPACES = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")


@dataclass(frozen=True)
class Rules:
    """Bounds of the first pass. Lengths are in characters."""

    link_share: float = 0.33  # above it a block is a list of links
    short: int = 70  # below it a block tells too little to be decided by words
    long: int = 200  # from it on fewer stop words are enough
    stop_low: float = 0.20
    stop_high: float = 0.30


@dataclass(slots=True)
class Block:
    text: str
    linked: int  # characters inside links
    tag: str
    apart: bool  # in a part that the page itself sets apart from the text
    article: int  # number of the article or main element that it stands in, else -1
    label: str = ""


def _sets_apart(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NEVER or (tag in OUTSIDE and not in_article):
        return True
    if not attributes:
        return False
    parts = frozenset() if tag in ("html", "body", "main") else ARTICLE_PARTS if tag == "article" else PARTS
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s{0,9}:\s{0,9}none|visibility\s{0,9}:\s{0,9}hidden", value, re.I)):
            return True
        if name in ("class", "id", "role"):
            words = [w.lower() for w in _NAME.findall(value)]
            # a wrapper of the text may be called "with-sidebar", and a header in an article holds its title
            if any(w in parts and not (w == "header" and in_article) for w in words) and not any(w in ("with", "has", "no") for w in words):
                return True
    return False


def _tags(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, value, attributes, place): kind is text, open or close."""
    at, end = 0, len(page)
    while at < end:
        mark = page.find("<", at)
        if mark < 0:
            yield "text", page[at:], "", at
            return
        if mark > at:
            yield "text", page[at:mark], "", at
        after = page[mark + 1 : mark + 3]
        if page.startswith("<!--", mark):
            over = re.compile(r"-?>").match(page, mark + 4) or _COMMENT_END.search(page, mark + 4)
            if not over:
                return
            at = over.end()
        elif after[:1].isascii() and (after[:1].isalpha() or (after[:1] == "/" and after[1:].isascii() and after[1:].isalpha())):
            tag = _TAG.match(page, mark)
            if not tag:  # the page ends in a tag
                return
            at = tag.end()
            name = tag[2].lower()
            yield ("close" if tag[1] else "open"), name, tag[3], mark
            if name in RAW and not tag[1]:
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                if not close:
                    return
                at = close.start()
        elif after[:1] in ("!", "?", "/"):
            close = page.find(">", mark)
            if close < 0:
                return
            at = close + 1
        else:
            yield "text", "<", "", mark
            at = mark + 1


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in its order, those without text left out."""
    out: list[Block] = []
    tags = list(_tags(page or ""))
    # elements that are closed, so that one left open needn't hold the rest of the page
    closed, waiting = set(), {}
    for i, (kind, name, *_) in enumerate(tags):
        if kind == "open" and name not in VOID:
            waiting.setdefault(name, []).append(i)
        elif kind == "close" and waiting.get(name):
            closed.add(waiting[name].pop())
    pieces: list[str] = []
    linked, links, breaks, tag, articles = 0, 0, 0, "", 0
    stack: list[tuple[str, bool, int, bool]] = []  # name, apart, article, closed
    holds: dict[str, int] = {}  # open elements by name
    place: tuple[bool, int] = (False, -1)

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, linked, tag, *place))
            pieces, linked = [], 0

    for i, (kind, value, attributes, _) in enumerate(tags):
        if kind == "text":
            text = entities.unescape(value)
            if text.strip():
                breaks = 0
                if links:
                    linked += len(" ".join(text.split()))
            pieces.append(text)
            continue
        if value == "br":
            breaks += 1
            pieces.append("\n")
            if breaks > 1:
                flush()
            continue
        inline = value in INLINE
        if value == "a":
            links = links + 1 if kind == "open" and i in closed else max(0, links - (kind == "close"))
        # a phrase set apart in a line ends the block too
        apart = not inline or (value == "span" and kind == "open" and i in closed and bool(attributes) and _sets_apart(value, attributes, place[1] >= 0))
        if inline and not apart and not (kind == "close" and stack and stack[-1][0] == value):
            continue
        flush()
        breaks = 0
        if kind == "close":
            if holds.get(value):
                while True:
                    name, *_ = stack.pop()
                    holds[name] -= 1
                    if name == value:
                        break
            tag = stack[-1][0] if stack else ""
        else:
            if value in SECTIONS:  # what was left open before ends here
                while stack and not stack[-1][3] and stack[-1][0] not in ("html", "body", *ARTICLES):
                    holds[stack.pop()[0]] -= 1
            elif value == "p" or value in HEADINGS or value in ("div", "ul", "ol", "table"):
                while stack and stack[-1][0] in ("p", *HEADINGS):
                    holds[stack.pop()[0]] -= 1
            above = stack[-1] if stack else ("", False, -1, True)
            tag = value
            if value in VOID:
                continue
            article = above[2]
            if value in ARTICLES and not above[1] and article < 0:
                article, articles = articles, articles + 1
            stack.append((value, above[1] or value in RAW or _sets_apart(value, attributes, article >= 0), article, i in closed))
            holds[value] = holds.get(value, 0) + 1
        place = (stack[-1][1], stack[-1][2]) if stack else (False, -1)
    flush()
    return out


def stop_share(text: str) -> float:
    """Share of the words that are stop words; in scripts without spaces,
    ten times that of signs that stand for them, up to 1."""
    words = _WORD.findall(text.lower())
    if not words:
        return 0.0
    signs = len(_NO_SPACES.findall(text))
    if 2 * signs > len(text):
        return min(1.0, 10 * sum(c in _SIGNS for c in text) / len(text))
    return sum(w in STOP_WORDS for w in words) / len(words)


def first_pass(block: Block, rules: Rules = Rules()) -> str:
    """``main``, ``rest``, or ``open`` for a block by itself."""
    n = len(block.text)
    if block.apart or block.linked > rules.link_share * n or not any(c.isalnum() for c in block.text):
        return "rest"
    if "©" in block.text and n < rules.long:
        return "rest"
    if n < rules.short or block.tag in HEADINGS:
        return "open"
    share = stop_share(block.text)
    if share >= rules.stop_high or (share >= rules.stop_low and n >= rules.long):
        return "main"
    # prose with few known words is left to its neighbours; a long block without any is none
    return "open" if share >= rules.stop_low / 2 or block.article >= 0 else "rest"


def second_pass(found: list[Block]) -> None:
    """Gives open blocks the label of their nearest decided neighbours."""
    i = 0
    while i < len(found):
        if found[i].label != "open":
            i += 1
            continue
        j = i
        while j < len(found) and found[j].label == "open" and found[j].article == found[i].article:
            j += 1

        def decided(at: int, home: int = found[i].article) -> str:
            if not 0 <= at < len(found) or (home >= 0 and found[at].article != home):
                return ""
            return found[at].label if found[at].label != "open" else ""

        before, after = decided(i - 1), decided(j)
        if not before and not after and found[i].article >= 0:
            before = "main"  # nothing else in the article tells
        before, after = before or after or "rest", after or before or "rest"
        for k in range(i, j):
            to_left, to_right = k - i, j - 1 - k
            if to_left == to_right and before != after:
                # a heading goes with what follows, other blocks with the text
                found[k].label = after if found[k].tag in HEADINGS else "main"
            else:
                found[k].label = before if to_left < to_right else after
        i = j


def classify(page: str | None, rules: Rules = Rules()) -> list[Block]:
    """The blocks of a page, each labelled ``main`` or ``rest``."""
    found = blocks(page)
    for block in found:
        block.label = first_pass(block, rules)
    second_pass(found)
    # where articles hold most of what was found, what stands beside them isn't the page's text
    main = [b for b in found if b.label == "main"]
    inside = sum(len(b.text) for b in main if b.article >= 0)
    if 2 * inside >= sum(len(b.text) for b in main):
        for block in main:
            block.label = "main" if block.article >= 0 else "rest"
    return found


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    return "\n".join(b.text for b in classify(page, rules) if b.label == "main")


def extract(df: DataFrame, html_col: str = "html", keep: Sequence[str] = ("page_id", "url"), rules: Rules = Rules()) -> DataFrame:
    """(keep..., text string, n_chars long, n_blocks int) for each row. One
    pass over the table, without a shuffle; 64 pages are in hand at a time."""
    clash = set(keep) & set(_RESULTS)
    if clash:
        raise ValueError(f"columns {sorted(clash)} clash with result columns")
    kept = [df.schema[c] for c in keep]
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").alias("__html"))
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_blocks", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [[b.text for b in classify(page, rules) if b.label == "main"] for page in part.column(len(kept)).to_pylist()]
                texts = ["\n".join(f) for f in found]
                columns = [part.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, found), pa.int32())], schema.names)

    return rows.mapInArrow(run, schema)
