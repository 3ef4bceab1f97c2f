"""Main text of web pages by line-block distribution.

The markup is cut into blocks, one for each block-level element (the "lines" of the method). Blocks inside elements
that never hold an article's text (menus, headers and footers of the page, sidebars, forms, notices, adverts, reader
comments, by their element, role, class or id) have no length in the distribution. The lengths of the other blocks
are summed over a sliding window of lines; where the sum rises above `surge` the text begins, where it falls to
nothing it ends (the dive), and of all such stretches the one with most text is the article, together with what stands
in the same container: the innermost one that holds most of the stretch. So noise inside an article doesn't end it,
and its short opening and closing lines stay. Neighbours of the container's element and class belong to it, too, and so
does a heading directly above; text of the stretch beside it, where that rises above `surge` by itself. An `article` or
`main` element is a container like any other: the distribution decides on every page.

Defined results: a null, empty or textless page gives the empty text. Character references are decoded once; white
space inside a block becomes one space; blocks are trimmed and joined in page order by one newline. Unclosed and
wrongly nested elements are closed where HTML closes them. Repeated rows are treated alike; an empty table gives an
empty result. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_columns

# The element names of HTML.
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "title", "select", "object", "canvas"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr",
    "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul", "br",
}
_NOISE = {"nav", "footer", "aside", "form", "menu", "button", "dialog", "fieldset", "head", "input", "label"}
_NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form", "note"}
_NOISE_WORDS = (
    "ads?|adverts?|advertisements?|advertising|adsense|adbox|banner|sponsor|sponsored|promos?|promotions?|nav|navbar|navigation|menu|menus|breadcrumbs?|header|masthead|topbar|"
    "footer|sidebar|side|aside|widgets?|related|recommended|share|sharing|social|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|signup|login|"
    "comments?|commentlist|comment-list|respond|replies|reply|disqus|pagination|pager|tags|copyright|legal|skip|skip-link|toolbar|search|form"
)
_NOISE_NAMES = re.compile(rf"(?!(?:has|with|no|is|show|page)[-_])(?:(?:{_NOISE_WORDS})(?:[-_\d].*)?|.*[-_](?:{_NOISE_WORDS}))", re.I)
#: What marks an article or main element as no article: those that hold reader comments or teasers.
_NOISE_ARTICLES = re.compile(r"(?:comments?|reply|replies|related|promos?|ads?|adverts?|teasers?|sponsor|sponsored)(?:[-_\d].*)?", re.I)
_CONTENT = {"article", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: The elements that hold parts of a page. The other block-level ones are parts of a text, or the whole page.
_CONTAINERS = {"article", "aside", "center", "dialog", "div", "fieldset", "footer", "form", "header", "main", "nav", "section", "td", "th"}
#: A quote opens a value only after an equals sign; a stray one is part of the tag.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</?[a-zA-Z](?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+(?:>|$)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s>/]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_CLASS = re.compile(r"\bclass\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_SPACE = re.compile(r"\s+")

#: (text, noise, content root, container, heading)
Block = tuple[str, bool, int, int, bool]
#: (container around it, element, class) of each container; the first is the page.
Places = list[tuple[int, str, str]]


def _is_noise(name: str, tag: str, in_content: bool, by_name: bool) -> bool:
    """Whether an element holds no article text. A header inside the article is the article's own."""
    if name in _NOISE or (name == "header" and not in_content):
        return True
    if name in ("body", "html") or "=" not in tag and "hidden" not in tag:
        return False
    names = _NOISE_ARTICLES if name in ("article", "main") else _NOISE_NAMES
    for key, value in _ATTRIBUTE.findall(tag[len(name) + 1 :]):
        key, value = key.lower(), value.strip("\"'").strip()
        if key == "role" and value.lower() in _NOISE_ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if by_name and key in ("class", "id") and any(names.fullmatch(x) for x in value.split()):
            return True
    return False


def blocks(html: str, by_name: bool = True) -> tuple[list[Block], Places]:
    """Each block that has text, in page order, and the containers. Root 0: outside article and main; others are containers.

    by_name: whether class names and ids tell noise.
    """
    out: list[Block] = []
    places: Places = [(0, "", "")]
    stack: list[tuple[str, bool, int, int]] = []
    piece: list[str] = []
    noise, root, place, at, end = False, 0, 0, 0, len(html)

    def flush() -> None:
        if piece:
            text = _SPACE.sub(" ", unescape("".join(piece))).strip()
            if text:
                out.append((text, noise, root, place, any(s[0] in _HEADINGS for s in stack[-3:])))
            piece.clear()

    while at < end:
        found = _TOKEN.search(html, at)
        if not found:
            piece.append(html[at:])
            break
        if found.start() > at:
            piece.append(html[at : found.start()])
        tag, at = found.group(0), found.end()
        named = _NAME.match(tag)
        if not named:
            if tag.startswith("<![CDATA["):
                piece.append(tag[9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name, closing = named.group(1).lower(), tag[1] == "/"
        if name in _BLOCK:
            flush()
        if closing:
            if name in _BLOCK and name != "p" or any(s[0] == name for s in stack[-3:]):
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == name:
                        if name in _BLOCK or stack[depth][1] != noise:
                            flush()
                        noise, root, place = stack[depth][1:]
                        del stack[depth:]
                        break
            continue
        if name in _RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = close.end() if close else (end if name in ("script", "style") else at)
            continue
        if name in _VOID or tag.endswith("/>"):
            continue
        if name in _BLOCK and stack and stack[-1][0] == "p":  # a block closes an open paragraph
            noise, root, place = stack[-1][1:]
            stack.pop()
        if name in ("li", "dd", "dt", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            noise, root, place = stack[-1][1:]
            stack.pop()
        bad = not noise and _is_noise(name, tag, root > 0, by_name)
        if bad or name in _CONTENT:
            flush()
        stack.append((name, noise, root, place))
        if name in _CONTAINERS:
            named = _CLASS.search(tag)
            places.append((place, name, named.group(1).strip("\"'") if named else ""))
            place = len(places) - 1
        if name in _CONTENT and not root and not noise:
            root = place
        noise = noise or bad
    flush()
    return out, places


def _stretches(lengths: list[int], window: int, surge: int) -> list[tuple[int, int]]:
    """The stretches of lines from a surge of the window's sum to its dive."""
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    stretches, begin = [], None
    for i, n in enumerate([*sums, 0]):
        if begin is None and n >= surge and i < len(lengths):
            begin = i
        elif begin is not None and n == 0:
            stretches.append((begin, i))
            begin = None
    return stretches


def _totals(values: Iterable[tuple[int, int]], places: Places) -> list[int]:
    """The sums of (container, value) in each container with those inside it, which all come after it."""
    totals = [0] * len(places)
    for place, n in values:
        totals[place] += n
    for place in range(len(places) - 1, 0, -1):
        totals[places[place][0]] += totals[place]
    return totals


def main_blocks(found: list[Block], places: Places, window: int = 3, surge: int = 80) -> list[str]:
    """The blocks of the article. `window` lines are summed; a stretch needs a window sum of `surge`."""
    good = [i for i, b in enumerate(found) if not b[1]]
    lengths = [0 if b[1] else len(b[0]) for b in found]
    stretches = _stretches(lengths, window, surge)
    if not stretches:
        return [found[i][0] for i in good]
    # a container of one block stands for the block
    held = _totals(((found[i][3], 1) for i in good), places)
    stands = [0] * len(places)
    for p in range(1, len(places)):
        stands[p] = p if held[p] > 1 else stands[places[p][0]]
    first, last = max(stretches, key=lambda s: (sum(lengths[s[0] : s[1]]), -s[0]))
    kept = {i for i in range(first, last) if lengths[i]}
    share = _totals(((stands[found[i][3]], lengths[i]) for i in kept), places)
    home = max(p for p, n in enumerate(share) if not p or 2 * n > share[0])
    if home:
        inside = [False] * len(places)
        for p in range(1, len(places)):
            like = places[p] == places[home] and (places[p][2] or places[p][1] == "section")
            inside[p] = p == home or bool(like) or inside[places[p][0]]
        # of the stretch beside the container, what rises above the surge by itself belongs to it
        beside = [n if i in kept and not inside[found[i][3]] else 0 for i, n in enumerate(lengths)]
        kept = {i for a, b in _stretches(beside, window, surge) for i in range(a, b) if beside[i]}
        kept |= {i for i in good if inside[found[i][3]]}
    else:
        kept |= {i for a, b in stretches for i in range(a, b) if lengths[i] and not stands[found[i][3]]}
    # the heading above, with the short lines under it
    above = [i for i in good if i < min(kept)][-2 * window :]
    headed = [i for i in above if found[i][4]]
    if headed and not found[min(kept)][4]:
        kept |= {i for i in above if i >= headed[-1]}
    return [found[i][0] for i in sorted(kept)]


def extract(html: str | None, window: int = 3, surge: int = 80) -> str:
    """The main text of a page. Where names of classes mark everything as noise, they are not believed."""
    if not html:
        return ""
    return "\n".join(main_blocks(*blocks(html), window, surge) or main_blocks(*blocks(html, by_name=False), window, surge))


def main_text(pages: DataFrame, *, html: str = "html", window: int = 3, surge: int = 80, carry: list[str] | None = None) -> DataFrame:
    """The rows of pages with text and n_chars (code points)."""
    carry = pages.columns if carry is None else carry
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def make():
        def run(cols):
            texts = [extract(v, window, surge) for v in cols[0].to_pylist()]
            return [texts, [len(t) for t in texts]]

        return run

    return map_columns(pages, [html], carry, fields, make)
