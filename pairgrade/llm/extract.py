"""Main text of web pages by tag-path ratios.

A page is cut into blocks (text between two block-level tags) and each block
gets its tag path from the root: block-level ancestors with class and id, not
the inline ones.  Per path, text length, punctuation, link text and blocks are
summed; the path's ratio is text per block, times punctuation per block, times
the share of text outside links.  The ratios of the blocks in page order are
smoothed with a Gaussian, fused with the unsmoothed ones (geometric mean), and
averaged per path again.  Paths at or above `SHARE` of the best one are the
core.  The containers of the core paths (the article or main around them, else
their parent) say what else is the article: blocks below them, at any depth, that are not
boilerplate, such as headings, cells, nested lists and short paragraphs.  In an
article or main, links don't matter; elsewhere a path of mostly links that is
no heading is a menu before the first and after the last core block.

Scripts, styles, forms, menus, headers, footers, asides, and elements whose
class, id or role names an advert, notice, sidebar, comment section and the
like are boilerplate whatever their ratio; a header inside an article is not,
and a name doesn't count on an element that holds most of the page's text
outside links, unless an article or main with text lies beside it.

Edge cases: null, empty and text-free pages give an empty text; unclosed and
stray tags, unclosed comments and quotes are read as far as they go; repeated
rows give equal results; page length is not bounded by the method.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE, LINKS = 0.3, 0.6

# Fixed: names of HTML elements by kind, and words that name boilerplate in class, id and role.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BOILERPLATE = frozenset("nav footer aside form button select fieldset dialog menu svg canvas object head audio video map datalist".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription paywall sidebar sidebars aside widget widgets related recommended recommendations share sharing social comment comments commentlist "
    "reply replies respond discussion disqus nav navbar navigation menu menus breadcrumb breadcrumbs footer foot header masthead topbar toolbar pagination pager login signup "
    "search copyright legal disclaimer hidden skip contentinfo complementary".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section div main body td th".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S)
_OPEN = re.compile(r"</?[a-zA-Z]|<[!?]")
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HEADING = re.compile(r"h[1-6](?:\[|$)")
_POINT = re.compile(r"[.,;:!?。、，！？；：…]")


def _kind(tag: str, attrs: str, inside: bool) -> tuple[str, bool, bool]:
    """The element's step in tag paths, whether it is boilerplate, and whether a name says so; inside: of an article."""
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return tag, tag in BOILERPLATE or tag == "header" and not inside, False
    named, step, bad = False, tag, tag in BOILERPLATE or tag == "header" and not inside
    for name, value in _NAMED.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            step += f"[{name}={value}]"
            if tag not in ("html", "body", "main", "article") or name == "class" and tag == "article":
                found = {x.lower() for x in _PART.findall(value)}
                named |= bool(found & NAMES) and not (tag == "header" and inside or found & {"header", "masthead", "banner"} and inside and not found & NAMES - {"header", "masthead", "banner"})
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            bad |= name != "hidden" or value.lower() != "until-found"
        elif name == "style":
            bad |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    return step, bad, named


def blocks(page: str) -> tuple[list[tuple[int, int, str, int, bool]], dict[int, int], set[int]]:
    """(path, article, text, characters in links, boilerplate) of each block in page order, each path's parent, and
    the paths of headings.
    Paths are numbers, equal for equal paths; article is the path of the article or main around the block, or 0."""
    numbers: dict[tuple[int, str], int] = {}
    stack: list[tuple[str, int, bool, int, int]] = []  # tag, path, boilerplate, path of the article it is in or 0, named element or 0
    outer: list[int] = [0]  # of each named element the one around it; 0 stands for the page
    out, text, linked, links, at = [], [], 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            if whole := " ".join(html.unescape("".join(text)).split()):
                _, path, bad, article, named = stack[-1] if stack else ("", 0, False, 0, 0)
                out.append((path, article, whole, min(linked, len(whole)), bad, named))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        text.append(piece)
        if links:
            linked += len(piece.strip())

    while (lt := page.find("<", at)) >= 0:
        if lt > at:
            add(page[at:lt])
        m = _TOKEN.match(page, lt)
        if m is None:
            if _OPEN.match(page, lt):  # a tag that the page's end cuts off
                at = len(page)
                break
            add("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attrs = tag.lower(), bool(m[1] or m[4]), (m[3] if m[2] else m[6]) or ""
        if tag in RAW and not closing:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            text.append("\n")
        elif tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
        elif tag in VOID:
            flush()
        elif closing:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            links = 0
        else:
            flush()
            ends = CLOSES.get(tag, set()) | {"p"}
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    del stack[i:]
                elif stack[i][0] in SCOPE:
                    break
            _, above, bad, article, named = stack[-1] if stack else ("", 0, False, 0, 0)
            step, own, by_name = _kind(tag, attrs, bool(article))
            path = numbers.setdefault((above, step), len(numbers) + 1)
            if by_name:
                outer.append(named)
                named = len(outer) - 1
            stack.append((tag, path, bad or own, path if tag in ("article", "main") and not article else article, named))
    add(page[at:])
    flush()
    # Text outside links, all and in articles, in each named element; an element's number is larger than that around it.
    plain, told = [0] * len(outer), [0] * len(outer)
    for _, article, text_, n, bad, named in out:
        if not bad:
            plain[named] += len(text_) - n
            told[named] += (len(text_) - n) * bool(article)
    for i in range(len(outer) - 1, 0, -1):
        plain[outer[i]] += plain[i]
        told[outer[i]] += told[i]
    gone = [False] * len(outer)
    for i in range(1, len(outer)):
        gone[i] = gone[outer[i]] or 2 * plain[i] <= plain[0] or told[i] < told[0]
    return [(*b[:4], b[4] or gone[b[5]]) for b in out], {path: above for (above, _), path in numbers.items()}, {path for (_, step), path in numbers.items() if _HEADING.match(step)}


def main_text(page: str | None) -> str:
    """The article's blocks, joined by an empty line."""
    found, parent, headings = blocks(page or "")
    live = [b for b in found if not b[4]]
    if not live:
        return ""
    sums: dict[int, list[float]] = {}
    for path, _, text, linked, _ in live:
        s = sums.setdefault(path, [0, 0, 0, 0])
        for i, x in enumerate((len(text), len(_POINT.findall(text)), linked, 1)):
            s[i] += x
    ratio = {p: t / n * (1 + dots / n) * (1 - min(1.0, linked / t)) for p, (t, dots, linked, n) in sums.items()}
    row = [ratio[b[0]] for b in live]
    weights = {d: math.exp(-d * d / 2) for d in (-2, -1, 0, 1, 2)}
    fused: dict[int, float] = dict.fromkeys(sums, 0.0)
    for i, b in enumerate(live):
        near = [(row[i + d], w) for d, w in weights.items() if 0 <= i + d < len(row)]
        fused[b[0]] += math.sqrt(row[i] * sum(x * w for x, w in near) / sum(w for _, w in near)) / sums[b[0]][3]
    # Much text counts more than one long block: the best path is judged with its total length.
    best = max(fused, key=lambda p: (fused[p] * math.sqrt(sums[p][0]), -p))
    core = {p for p, x in fused.items() if x >= SHARE * fused[best]}
    homes = {b[1] or parent.get(b[0], 0) for b in live if b[0] in core}
    inside: dict[int, bool] = {0: 0 in homes}

    def below(path: int) -> bool:
        """In a container of the core."""
        way = []
        while path not in inside and path not in homes:
            way.append(path)
            path = parent.get(path, 0)
        found = path in homes or inside[path]
        inside.update(dict.fromkeys(way, found))
        return found

    at = [i for i, b in enumerate(live) if b[0] in core]
    menus = {p for p, (t, _, linked, _) in sums.items() if linked >= LINKS * t} - headings

    def kept(i: int, b: tuple[int, int, str, int, bool]) -> bool:
        return b[0] in core or below(b[0]) and (b[1] in homes or at[0] < i < at[-1] or b[0] not in menus)

    return "\n\n".join(b[2] for i, b in enumerate(live) if kept(i, b))


def extract(pages: DataFrame, markup: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per row of `pages`: the `keep` columns, text and n_chars (code points)."""
    rows = pages.select(*keep, F.col(markup).alias("_html"))
    schema = rows.select(*keep).withColumn("text", F.lit("")).schema

    def read(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                text = [main_text(x.as_py()) for x in part.column("_html")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(text, pa.string())], names=[*keep, "text"])

    return rows.mapInArrow(read, schema).withColumn("n_chars", F.length("text").cast("long"))
