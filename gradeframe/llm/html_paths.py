"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text, each with its root-to-leaf path of tags. Text length, length of link
text and punctuation are summed per path, smoothed over paths that follow each other in the page, fused into
one score, and held against a threshold. The paths above it decide which element holds the main text; every
block in it stays, short ones too (list items, cells, captions, quotes). Parts that their markup names as
something else (menus, adverts, comments, ...) take no part in this. Paths within an article or main element
count more, but decide nothing alone.
"""

import re
from collections import namedtuple
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags of HTML by what they mean for text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp "
    "small span strike strong sub sup time tt u var".split()
)
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
CLOSED_BY_SAME = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
SCOPES = set("table ul ol dl article section div main body html template button object td th caption svg math".split())
NOISE_TAGS = set(
    "head script style title noscript template nav footer aside form button select textarea option iframe "
    "object svg math canvas audio video menu dialog datalist xmp noembed noframes".split()
)
# Words in class, id and role that mark parts beside the main text.
NOISE_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar "
    "widget menu nav navbar navigation breadcrumb breadcrumbs header footer masthead related recommended "
    "recommendations share sharing social toolbar pagination pager copyright disclaimer complementary contentinfo search "
    "dialog".split()
)
COMMENT_WORDS = set("comment comments commentlist disqus respond reply replies".split())
# Words that may follow a noise word in a name (``ad-slot``), and that make it a state of the page
# (``has-sidebar``).
PART_WORDS = set(
    "area bar block box column container content group inner item items left link links list outer panel right section "
    "slot text title top bottom unit wrap wrapper zone".split()
)
STATE_WORDS = set("has have is no non not show shows with without".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Tags that stand for text, not for a region of the page.
TEXT_TAGS = HEADINGS | set(
    "p ul ol li dl dt dd table caption thead tbody tfoot tr td th colgroup figure figcaption blockquote pre details "
    "summary center address hgroup".split()
)

#: Weight of paths within an article or main element.
MAIN_WEIGHT = 1.25

#: ``noise``: by tags, attributes and words that are certain; ``named``: numbers of the elements around that only a
#: noise word in their name marks; ``main``: number of the innermost article or main element, else 0; ``nodes``:
#: numbers of the elements of the path.
Block = namedtuple("Block", "path text linked noise named main nodes")
Open = namedtuple("Open", "tag noise certain number")

_TAG = re.compile(r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""")
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")


def _names_noise(name: str) -> bool:
    """Whether one class, id or role names a part beside the main text.

    The noise word ends the name (``page-footer``), or begins it with nothing but words for parts after it
    (``ad-slot``). A name of another thing with such a word in it (``search-results-page``, ``has-sidebar``) does not.
    """
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or words[0] in STATE_WORDS:
        return False
    return words[-1] in NOISE_WORDS or words[0] in NOISE_WORDS and set(words[1:]) <= PART_WORDS | NOISE_WORDS


def _marks(tag: str, rest: str, inside_main: bool) -> tuple[bool, bool]:
    """Whether a start tag marks noise, and whether it does so for certain, not by a name that a frame may have too."""
    if tag in NOISE_TAGS or tag == "header" and not inside_main:
        return True, True
    if not rest or tag in ("html", "body"):
        return False, False
    names: list[str] = []
    for name, *values in _ATTRIBUTE.findall(rest):
        name = name.lower()
        if name == "hidden":
            return True, True
        if name in ("class", "id", "role"):
            names += " ".join(values).split()
    if any(w.lower() in COMMENT_WORDS for name in names for w in _WORDS.findall(name)):
        return True, True
    return tag not in ("article", "main") and any(map(_names_noise, names)), False


def blocks_of(html: str | None) -> Iterator[Block]:
    """Blocks of a page in order. Unclosed and misnested tags are taken as browsers take them, in the main."""
    html = html or ""
    stack: list[Open] = []
    text: list[str] = []
    linked = at = opened = 0
    size = len(html)

    def block() -> Iterator[Block]:
        nonlocal linked
        words = "".join(text).split()
        if words:
            regions = [s for s in stack if s.tag not in INLINE]
            yield Block(
                "/".join(s.tag for s in regions),
                " ".join(words),
                linked,
                any(s.certain for s in stack),
                [s.number for s in stack if s.noise and not s.certain],
                max((s.number for s in stack if s.tag in ("article", "main")), default=0),
                [s.number for s in regions],
            )
        text.clear()
        linked = 0

    def close(tags, scopes=()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in scopes:
                return

    while at < size:
        start = html.find("<", at)
        start = size if start < 0 else start
        if start > at:
            piece = unescape(html[at:start])
            text.append(piece)
            if any(s.tag == "a" for s in stack):
                linked += len(piece.strip())
        if start == size:
            break
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        name = _NAME.match(html, start + 1)
        if not name:
            if html[start + 1 : start + 2] in ("!", "?", "/") and start + 1 < size:
                end = html.find(">", start)
                at = size if end < 0 else end + 1
            else:  # a lone sign
                text.append("<")
                at = start + 1
            continue
        tag = name[0].lower()
        found = _TAG.match(html, name.end())
        end = found.end() if found else html.find(">", name.end()) + 1
        if not end:  # cut off within a tag
            break
        at = end
        if tag[0] == "/":
            tag = tag[1:]
            if tag not in INLINE:
                yield from block()
                close((tag,), () if tag in SCOPES else SCOPES - {tag})
            else:
                close((tag,), CLOSES_P | SCOPES)
            continue
        if tag == "br" or tag == "wbr":
            text.append(" " if tag == "br" else "")
            continue
        if tag in VOID:
            if tag == "hr":
                yield from block()
            continue
        if tag not in INLINE:
            yield from block()
            if tag in CLOSES_P:
                close(("p",), SCOPES)
            if tag in CLOSED_BY_SAME:
                close(CLOSED_BY_SAME[tag], SCOPES)
        rest = html[name.end() : end - 1]
        noise, certain = _marks(tag, rest, any(s.tag in ("article", "main") for s in stack))
        if tag in RAW:
            close_at = re.compile(f"</{tag}", re.IGNORECASE).search(html, at)
            if not close_at:
                break
            at = html.find(">", close_at.start()) + 1 or size
            continue
        if rest.endswith("/") and tag in ("svg", "path", "math"):
            continue
        opened += 1
        stack.append(Open(tag, noise, certain, opened))
    yield from block()


def _smooth(values: list[float]) -> list[float]:
    padded = [values[0], *values, values[-1]]
    return [(a + 6 * b + c) / 8 for a, b, c in zip(padded, padded[1:], padded[2:])]


def content_paths(blocks: list[Block], threshold: float) -> set[str]:
    """Paths whose fused, smoothed and weighted ratios are at least ``threshold`` times the highest."""
    weight = {b.path: MAIN_WEIGHT if b.main else 1.0 for b in blocks}
    sums: dict[str, list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b.path, [0, 0, 0, 0])
        for i, value in enumerate((len(b.text), min(b.linked, len(b.text)), len(_PUNCTUATION.findall(b.text)), 1)):
            s[i] += value
    if not sums:
        return set()
    paths = list(sums)
    length = _smooth([(t - l) / n for t, l, _, n in sums.values()])
    marks = _smooth([p / n for _, _, p, n in sums.values()])
    fused = {p: weight[p] * a * (1 + b) ** 0.5 for p, a, b in zip(paths, length, marks)}
    # a short path stands with the text of the element around it, as a heading does
    around: dict[str, list[float]] = {}
    for path, (t, l, p, n) in sums.items():
        parts = path.split("/")
        for depth in range(max(1, len(parts) - 1), len(parts)):
            a = around.setdefault("/".join(parts[:depth]), [0, 0, 0])
            a[0] += t - l
            a[1] += n
            a[2] += p
    border = threshold * max(fused.values())
    chosen = set()
    for path, (t, l, _, n) in sums.items():
        parent = around.get("/".join(path.split("/")[:-1]), [0, 1, 0])
        near = weight[path] * parent[0] / parent[1] * (1 + parent[2] / parent[1]) ** 0.5
        if not _mostly_links(l, t) and max(fused[path], near) >= border:
            chosen.add(path)
    return chosen


def _mostly_links(linked: int, length: int) -> bool:
    return linked > 0.8 * length


def not_noise(found: list[Block]) -> list[Block]:
    """Blocks that are not marked as something else.

    A name marks nothing if its element holds most of the page's text and no article or main element stands outside
    it. Where nothing is left, articles in elements with such names are read.
    """
    found = [b for b in found if not b.noise]
    held: dict[int, int] = {}
    for b in found:
        for number in b.named:
            held[number] = held.get(number, 0) + len(b.text)
    whole = sum(len(b.text) for b in found)
    for number, size in held.items():
        outside = any(b.main and number not in b.named for b in found)
        if 2 * size > whole and not outside:
            found = [b._replace(named=[n for n in b.named if n != number]) for b in found]
    return [b for b in found if not b.named] or [b for b in found if b.named and max(b.named) < b.main]


def _region(b: Block) -> list[int]:
    """Numbers of the elements around a block, down to the innermost that is a region of the page."""
    tags = b.path.split("/") if b.path else []
    while tags and tags[-1] in TEXT_TAGS:
        tags.pop()
    return b.nodes[: len(tags)]


def _common(lists: list[list[int]]) -> list[int]:
    low, high = min(lists), max(lists)
    same = 0
    while same < min(len(low), len(high)) and low[same] == high[same]:
        same += 1
    return low[:same]


def main_text(html: str | None, threshold: float = 0.3) -> str:
    """Blocks of the main text joined by empty lines; empty without any.

    The innermost region around all blocks on chosen paths holds the main text. Its other blocks stay, as do those of
    the article around it that text tags enclose; lists of links go. Where the region is the whole body,
    blocks stay from the heading before the first chosen one to the last.
    """
    blocks = not_noise(list(blocks_of(html)))
    chosen = content_paths(blocks, threshold)
    core = [i for i, b in enumerate(blocks) if b.path in chosen]
    if not core:
        return ""
    region = _common([_region(blocks[i]) for i in core])
    depth = len(region)
    tags = blocks[core[0]].path.split("/")[:depth]
    mains = {blocks[i].main for i in core}
    article = mains.pop() if len(mains) == 1 else 0
    first = 0
    if set(tags) <= {"html", "body"}:
        first = core[0]
        while first and blocks[first - 1].path.rpartition("/")[2] in HEADINGS:
            first -= 1

    def stays(at: int, b: Block) -> bool:
        if b.path in chosen:
            return True
        last = b.path.rpartition("/")[2]
        if _mostly_links(b.linked, len(b.text)) and last not in HEADINGS:
            return False
        if set(tags) <= {"html", "body"}:
            return first <= at <= core[-1]
        return b.nodes[:depth] == region or bool(article) and article in b.nodes and last in TEXT_TAGS

    return "\n\n".join(b.text for at, b in enumerate(blocks) if stays(at, b))


def plain_text(html: str | None) -> str:
    """All visible text of a page, a line per block."""
    hidden = ("head", "script", "style", "template", "noscript")
    return "\n".join(b.text for b in blocks_of(html) if not set(b.path.split("/")) & set(hidden))


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of ``keep``, ``text`` and its number of code points ``n_chars`` for every row.

    Null, empty and text-free pages give an empty text; repeated rows are read each; very long pages are
    read in one pass; an empty table gives an empty table; other columns are not read. Nothing is shuffled.
    """

    @F.pandas_udf("string")
    def read(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    found = pages.select(*keep, read(html).alias("text"))
    return found.select(*keep, "text", F.length("text").cast("long").alias("n_chars"))
