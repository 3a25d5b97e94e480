"""Main text of web pages by two-pass block rules.

A tokenizer cuts a page into blocks at block-level tags and keeps, for each block, its text, the share of it inside links,
and what it stands in. Pass one looks at each block by itself: mostly links means out; so many words with so high a
density of stop words mean in, and so do many words in an article or main element; the rest is ambiguous. What an element says
of itself is a feature: blocks that stand in menus, headers, footers, sidebars, notices, adverts, forms or reader comments are out however dense, and take no
part in pass two. There each ambiguous block gets the label of its nearest decided neighbour. Neighbours are looked for in the block's own
container first (the same article, or what lies outside of any); where two are equally near, an article's block is in, a
heading goes with what follows, and any other block is in if both are. Without a decided neighbour in its article a block is in.

Text rules: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined
by a line feed in page order; nothing is capped.

Edge cases: null or empty html gives the empty text; broken markup is read as far as it goes (an element that never ends
lasts to the end of its parent; a script that never ends hides the rest); null ids and urls are kept; repeated rows are
answered each; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, map_texts

#: Elements, fixed values.
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript head title svg math iframe object canvas audio video select textarea button datalist".split())
RAW = frozenset("script style textarea title template noscript iframe svg math".split())
OUT = frozenset("nav footer aside form menu dialog fieldset".split())
INSIDE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: What an element closes when it opens, fixed values.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
CLOSES |= {x: {"p"} for x in BLOCK - VOID - set(CLOSES) - {"html", "head", "body", "title"}}
#: Words in class, id and role that mark what isn't main text, fixed values.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert"
    " popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar side-bar aside widget footer header masthead"
    " topbar toolbar comment comments disqus respond reply replies share sharing social related recommended newsletter subscribe subscription"
    " signup login search searchform form toc complementary contentinfo".split()
)
#: Words that go with marks in compounds without changing what they say.
FILLERS = frozenset(
    "box block container wrapper wrap inner outer area section list item items link links button buttons bar bars left right top bottom main primary secondary slot unit"
    " panel post posts article articles entry story stories site page global local row col column columns text body content title icon icons group zone region module js u l m".split()
)
#: Marks that say nothing inside an article's own header.
_HEADERS = frozenset(("header", "masthead"))
STOP_WORDS = frozenset(
    "the of and to in a is that for it was on are as with be by this an from or at not have which one you were her all their there been if more when"
    " will would who so no he his they we but has had"
    " de la que el en y los se del las un por con una su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre no"
    " le les des et du est dans une qui pas sur au par il avec ce sont plus ne aux ou mais son ses cette"
    " der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über".split()
)
LINKS_OUT = 0.5
DENSE = 0.12
#: Words that a dense block needs, and a block of an article of any density.
SHORT, LONG = 8, 15
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@lru_cache(maxsize=1 << 16)
def _mark(token: str) -> frozenset[str]:
    """The marks of one class, id or role: itself, or the marked parts of a compound of nothing but marks, fillers and numbers."""
    if token in MARKS:
        return frozenset((token,))
    parts = [x for x in re.split(r"[-_]+|(?<=[a-z])(?=[0-9])", token) if x]
    return frozenset(parts) & MARKS if all(x in MARKS or x in FILLERS or x[0].isdigit() for x in parts) else frozenset()


def _marked(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element holds something else than main text."""
    if name in OUT or (name == "header" and not inside):
        return True
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "style" and _INVISIBLE.search(value)):
            return True
        if key in ("class", "id", "role") and name not in ("html", "body", "article", "main"):
            if any(_mark(t) - (_HEADERS if inside else frozenset()) for t in value.lower().split()):
                return True
    return False


@dataclass
class Block:
    """A block: its text, how many characters of it stand in links, whether in what is out, in which article (0: none), whether it is a heading."""

    text: str
    linked: int = 0
    out: bool = False
    article: int = 0
    heading: bool = False


def blocks(page: str) -> list[Block]:
    """The blocks that have text."""
    found: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # name, and out and inside as they were before it
    opened: Counter = Counter()  # names in the stack
    parts: list[str] = []
    linked = links = 0
    out, inside, articles, heading = False, 0, 0, False
    at = 0
    n = len(page)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, linked, out, inside, heading))
            parts, linked = [], 0

    def close(name: str) -> None:
        """Leaves the innermost open element of that name and all within it."""
        nonlocal out, inside
        top = None
        while top != name:
            top, out, inside = stack.pop()
            opened[top] -= 1

    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            c = m[0]
            if c[0] != "<" or c == "<":
                parts.append(c)
                if links:
                    linked += len(c.strip())
            continue
        name = name.lower()
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if not closing and name in HIDDEN:
            if name in RAW and not attributes.endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else n
                if name in BLOCK:
                    flush()
                continue
            if name == "head":
                end = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
                at = (end.end() if end[0][1] == "/" else end.start()) if end else at
                continue
        if name == "a":
            links = 0 if closing else 1
            continue
        if name not in BLOCK and name not in HIDDEN:
            if name in VOID:
                continue
            if not closing and attributes and _marked(name, attributes, bool(inside)):
                flush()
                stack.append((name, out, inside))
                opened[name] += 1
                out = True
            elif closing and opened[name]:
                flush()
                close(name)
            continue
        flush()
        if name in VOID:
            continue
        if closing:
            if opened[name]:
                close(name)
            links, heading = 0, False
            continue
        gone = CLOSES.get(name)
        if gone:
            while stack and stack[-1][0] in gone:
                close(stack[-1][0])
        stack.append((name, out, inside))
        opened[name] += 1
        heading = name in HEADINGS
        if not out:
            out = name in HIDDEN or _marked(name, attributes, bool(inside))
        if name in INSIDE and not inside:
            articles += 1
            inside = articles
    flush()
    return found


def first_pass(block: Block) -> tuple[int, str]:
    """1 in, 0 out, -1 ambiguous, and by what: links, density, length, mark or nothing."""
    if block.linked > LINKS_OUT * len(block.text):
        return 0, "links"
    if block.out:
        return 0, "mark"
    words = block.text.lower().split()
    dense = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    if len(words) >= SHORT and dense >= DENSE:
        return 1, "density"
    if len(words) >= LONG and block.article:
        return 1, "length"
    if len(words) >= LONG and dense < DENSE / 4 and block.linked:
        return 0, "density"
    return -1, ""


def _nearest(given: list[tuple[int, str]], own: list[int], order: range) -> dict[int, int]:
    """Of each ambiguous one of the blocks in own the position in it of the last decided one before it, in that order."""
    near, last = {}, None
    for k in order:
        if given[own[k]][0] >= 0:
            last = k
        elif last is not None:
            near[k] = last
    return near


def second_pass(found: list[Block], given: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Ambiguous blocks get their neighbours' labels, container by container, in time in proportion to the blocks."""
    labels = list(given)
    containers: dict[int, list[int]] = {}
    for i, block in enumerate(found):
        if not block.out:
            containers.setdefault(block.article, []).append(i)
    anything = any(x[0] == 1 for x in given)
    for article, own in containers.items():
        before, after = _nearest(given, own, range(len(own))), _nearest(given, own, range(len(own) - 1, -1, -1))
        for k, i in enumerate(own):
            if given[i][0] >= 0:
                continue
            b, f = before.get(k), after.get(k)
            if b is None and f is None:
                labels[i] = int(bool(article) or not anything), "container"
                continue
            if b is None or f is None or k - b != f - k:
                at = f if b is None or (f is not None and f - k < k - b) else b
                labels[i] = given[own[at]][0], "neighbour"
                continue
            one, two = given[own[b]][0], given[own[f]][0]
            labels[i] = (one | two) if article else two if found[i].heading else one & two, "neighbour"
    return labels


def labelled(page: str) -> tuple[list[Block], list[tuple[int, str]]]:
    """The blocks of a page with their labels (1 in, 0 out) and what gave them."""
    found = blocks(page)
    return found, second_pass(found, [first_pass(b) for b in found])


def main_text(page: str | None) -> str:
    """The main text of a whole page."""
    if not page:
        return ""
    found, labels = labelled(page)
    return "\n".join(b.text for b, (x, _) in zip(found, labels, strict=True) if x)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every whole page. One pass, no shuffle."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for part in bounded(batch):
                texts = [main_text(t) for t in part["text"]]
                yield {"page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    columns = {"page_id": F.col(id_column).cast("long"), "url": F.col(url_column).cast("string"), "text": F.col(html_column)}
    return map_texts(pages, columns, run, "page_id long, url string, text string, n_chars long")
