"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines, one for each block element. Lines of page furniture
(menus, headers, footers, sidebars, notices, adverts, forms, comments of readers)
count as empty, and each piece of furniture leaves room as wide as the window;
lines that are mostly links count as empty too. The text lengths of a sliding
window of lines then surge where main text starts and dive where it ends, and the
lines between a surge and its dive are kept. Lines of shorter regions are kept if
they are the same kind of block, in the same container, as kept lines. Where a page
marks its article, only lines inside can count, and all of them do.

Words in class, id or role name furniture, never an element that holds the marked
article or, on a page without a mark, most of the text. Words that also name parts
of articles (header, share, related, search) count only as whole names, and inside
a marked article only if the element's own text is sparse.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import fresh, with_fields

WINDOW = 3  # lines summed
SURGE = 86  # window length from which a region counts as main text, unless no region reaches it

# Element names of HTML by their role.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "svg", "object", "canvas", "audio", "video", "annotation", "annotation-xml"}
FURNITURE = {"nav", "footer", "aside", "form", "dialog", "menu", "button", "select", "datalist", "label", "fieldset"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "mark", "nobr", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
    "u", "var", "wbr", "img", "picture", "source",
    "math", "semantics", "mrow", "mi", "mo", "mn", "ms", "mtext", "mspace", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mover",
    "munder", "munderover", "mtable", "mtr", "mtd", "mfenced", "mstyle", "mpadded", "mphantom", "menclose", "merror",
}
# ASCII case only: the page itself is searched, since other letters change their length in lower case
RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW | {"title"}}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
CLOSED_BY_NEXT = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
MAIN = {"article", "main"}
TEXTUAL = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre", "li", "td", "th", "dt", "dd", "figcaption", "caption"}
# Words in class, id or role that mark page furniture, whatever follows or precedes them in the name, ...
ALWAYS = (
    "ad|ads|advert|adverts|advertisement|advertising|adsense|adbox|breadcrumb|breadcrumbs|comment|comments|commentlist|disqus|cookie|cookies"
    "|consent|gdpr|copyright|footer|menu|menus|nav|navbar|navigation|newsletter|notice|notices|popup|modal|pagination|pager|promo|promotion"
    "|replies|respond|sidebar|sponsor|sponsored|subscribe|subscription|signup|login"
)
# ... but not behind these, ...
UNLESS = "no|non|not|has|have|had|with|without|hide|hidden|show|is|by|main|left|right|pre|un"
# ... and words that do so only as the whole name, between these.
WHOLE = (
    "alert|banner|foot|header|masthead|popular|recommended|recommendations|related|reply|share|sharing|side|social|search|skip|tags|toolbar"
    "|trending|widget|widgets|complementary|contentinfo|dialog"
)
BEFORE = "site|page|global|blog|top|bottom"
AFTER = r"area|bar|block|box|buttons?|container|form|icons?|inner|items?|links?|list|posts?|section|title|widget|wrap|wrapper|zone|\d+"
SURE = re.compile(
    rf"(?:(?!(?:{UNLESS})[-_])[a-z0-9]+[-_]+)*(?:{ALWAYS})(?:[-_]+\w+)*|(?:left|right)[-_]*sidebar|(?:ad|ads|cookie|comment)\d+", re.A)
WEAK = re.compile(rf"(?:(?:{BEFORE})[-_]+)?(?:{WHOLE})(?:[-_]+(?:{AFTER}))*", re.A)
KEEPS = {"main", "content", "article", "post", "entry", "story"}
TOKEN = re.compile(
    r"<!--(?P<note>.*?)(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?](?P<decl>[^>]*)(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.S)
ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
HIDDEN, SURELY, PERHAPS = "hidden", "surely", "perhaps"


def named(tag: str, attrs: str) -> str | None:
    """What the attributes of an element say: that it is hidden, or furniture, surely or perhaps."""
    said = None
    for name, *values in ATTR.findall(attrs):
        value, name = "".join(values), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (
                name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return HIDDEN
        if name not in ("class", "id", "role") or tag in ("main", "h1") or (name == "id" and (tag in TEXTUAL or tag in INLINE)):
            continue
        words = value.lower().split()
        if any(SURE.fullmatch(w) for w in words) and (tag != "article" or re.search(r"comment|reply|replies", value, re.I)):
            said = SURELY if not KEEPS & set(words) or re.search(r"comment", value, re.I) else said
        elif tag != "article" and any(WEAK.fullmatch(w) for w in words) and not KEEPS & set(words):
            said = said or PERHAPS
    return said


class Page:
    """The tokens of a page in order, and for each element its text, links and lines.

    ``steps``: (element, None) opens it, (element, False) closes it, (element,
    text) is text in it. Element 0 is the page.
    """

    def __init__(self, page: str):
        self.tag, self.said, self.parent = ["html"], [None], [0]
        self.chars, self.linked, self.lines, self.marks = [0], [0], [0], [0]
        self.steps: list[tuple[int, str | bool | None]] = []
        stack, anchors, fresh_line = [0], 0, True

        def close(at: int) -> None:
            nonlocal anchors
            while len(stack) > at:
                e = stack.pop()
                anchors -= self.tag[e] == "a"
                for sums in (self.chars, self.linked, self.lines, self.marks):
                    sums[stack[-1]] += sums[e]
                self.steps.append((e, False))

        at, size = 0, len(page)
        while at < size:
            m = TOKEN.match(page, at)
            at = m.end()
            tag = m["tag"]
            if tag is None:
                text = entities.unescape(m["text"]) if m["text"] else m["cdata"]
                if text:
                    e, count = stack[-1], len("".join(text.split()))
                    self.chars[e] += count
                    self.linked[e] += count if anchors else 0
                    self.lines[e] += fresh_line and count > 0
                    fresh_line = fresh_line and not count
                    self.steps.append((e, text))
                continue
            tag, closing = tag.lower(), bool(m["end"])
            if not closing and (tag in RAW or tag in ("title", "head")):
                if tag == "head":
                    continue
                end = RAW_END[tag].search(page, at)
                end = page.find(">", end.end()) if end else -1
                at = end + 1 if end >= 0 else size
                if tag not in ("svg", "annotation", "annotation-xml"):
                    self._break(stack[-1])
                    fresh_line = True
                continue
            fresh_line = fresh_line or tag not in INLINE
            if closing:
                where = len(stack) - 1
                while where and self.tag[stack[where]] != tag:
                    where -= 1
                if where and (tag in ("body", "html") or not self._guarded(stack, where, tag)):
                    close(where)
                elif tag not in INLINE:
                    self._break(stack[-1])
                continue
            if tag in CLOSED_BY_NEXT:
                where = len(stack) - 1
                while where and self.tag[stack[where]] in INLINE:
                    where -= 1
                if where and self.tag[stack[where]] == tag:
                    close(where)
            if tag in VOID:
                if tag not in INLINE:
                    self._break(stack[-1])
                continue
            e = len(self.tag)
            said = named(tag, m["attrs"]) if m["attrs"] and tag not in ("html", "body") else None
            for column, value in ((self.tag, tag), (self.said, said), (self.parent, stack[-1]), (self.chars, 0), (self.linked, 0), (self.lines, 0)):
                column.append(value)
            self.marks.append(int(tag in MAIN and said is None))
            anchors += tag == "a"
            stack.append(e)
            self.steps.append((e, None))
        close(1)

    def _break(self, e: int) -> None:
        self.steps.append((e, True))

    def _guarded(self, stack: list[int], where: int, tag: str) -> bool:
        """An end tag inside furniture does not close what lies around it."""
        return any(self.tag[e] in FURNITURE or self.said[e] for e in stack[where + 1:]) and self.tag[stack[where]] == tag

    def furniture(self, e: int, inside: bool) -> bool:
        """Is the element no main text? ``inside``: it lies in a marked article."""
        tag, said = self.tag[e], self.said[e]
        if said == HIDDEN:
            return True
        if self.marks[e]:
            return False
        most = not self.marks[0] and 2 * self.chars[e] > self.chars[0]
        if tag in FURNITURE and tag != "form":
            return True
        if tag == "form" or said == SURELY or (tag == "header" and not inside):
            return not most
        sparse = self.chars[e] < SURGE * self.lines[e] or 2 * self.linked[e] > self.chars[e]
        return said == PERHAPS and not most and (sparse or not inside)


def lines_of(page: str) -> tuple[list[str], list[int], list[bool], list[tuple[int, str]]]:
    """Lines of a page, the length of their text in links, whether they lie in a marked article, and their (container, block element).

    Furniture becomes ``WINDOW`` empty lines.
    """
    whole = Page(page)
    lines: list[str] = []
    linked: list[int] = []
    within: list[bool] = []
    place: list[tuple[int, str]] = []
    part: list[tuple[str, bool]] = []
    mains = anchors = 0
    skip = -1  # the piece of furniture around this place
    block = [0]  # open block elements

    def flush():
        text = " ".join("".join(t for t, _ in part).split())
        if text:
            lines.append(text)
            linked.append(len(" ".join("".join(t if a else " " for t, a in part).split())))
            within.append(mains > 0)
            place.append((whole.parent[block[-1]], whole.tag[block[-1]]))
        part.clear()

    for e, step in whole.steps:
        tag = whole.tag[e]
        if step is None or step is False:
            inline = tag in INLINE
            if skip >= 0:
                skip = -1 if step is False and e == skip else skip
                continue
            if step is None and whole.furniture(e, mains > 0):
                flush()
                for column, empty in ((lines, ""), (linked, 0), (within, mains > 0), (place, (-1, ""))):
                    column.extend([empty] * WINDOW)
                skip = e
                continue
            if not inline:
                flush()
                block.append(e) if step is None else block.pop()
            turn = 1 if step is None else -1
            mains += turn * (tag in MAIN)
            anchors += turn * (tag == "a")
        elif skip < 0:
            if step is True:
                flush()
            else:
                part.append((step, anchors > 0))
    flush()
    return lines, linked, within, place


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of one page; empty where it has none."""
    lines, linked, within, place = lines_of(page)
    if not lines:
        return ""
    size = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    marked = np.array(within)
    if (size[marked] > 0).any():
        return " ".join(line for line, inside in zip(lines, within, strict=True) if inside and line)
    text = np.where(np.array(linked) * 2 > size, 0, size)
    total = np.r_[0, np.cumsum(text)]
    block = total[np.minimum(np.arange(len(text)) + window, len(text))] - total[:-1]  # line i and those after it
    on = np.flatnonzero(np.diff(np.r_[0, block > 0, 0]))
    regions = [(a + np.flatnonzero(text[a:b])[[0, -1]], block[a:b].max()) for a, b in zip(on[::2], on[1::2], strict=True)]
    least = min(surge, max((peak for _, peak in regions), default=0))
    kept = np.zeros(len(lines), dtype=bool)
    for (first, last), peak in regions:
        kept[first:last + 1] |= peak >= least
    kinds = {place[i] for i in np.flatnonzero(kept & (text > 0))}
    kept |= (text > 0) & np.fromiter((x in kinds for x in place), dtype=bool, count=len(place))  # short ones of the same make
    return " ".join(lines[i] for i in np.flatnonzero(kept & (size > 0)))


def main_texts(pages: DataFrame, html: str = "html", window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """``pages`` plus text and n_chars, its code points, without the html column.

    Null or empty pages and pages without main text get an empty text. Rows are
    kept as they are, repeated ones too; columns named like the new ones give way.
    """

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda page: main_text(page, window, surge) if page else "")

    (found,) = fresh(pages, "__text")
    out = pages.withColumn(found, extract(F.col(html)))
    return with_fields(
        out, F.struct(F.col(found).alias("text"), F.length(found).alias("n_chars")), {"text": "string", "n_chars": "long"}
    ).drop(found, html)
