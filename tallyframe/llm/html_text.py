"""Main text of web pages by composite text density.

A page is parsed into elements (unclosed and implied end tags are allowed
for).  For every element under the body, the composite text density is its
characters per tag, adjusted by the share of characters and tags in links;
its density sum adds up the densities of its children.  The element with the
largest density sum leads the selection: the smallest density on the path
from the body down to it is the threshold, and every element at or above the
threshold contributes its own subtree of largest density sum.  When the leading
element stands in an ``article`` or ``main``, these bound the text: every one
at or above the threshold counts, and all of it.

Elements that are no article text by what they are (menus, headers and footers
of the page, controls, scripts, styles) are left out before densities are taken,
and so are those that are named as such (sidebars, notices, adverts, reader
comments).  A form or fieldset goes with its text unless it holds the page's article
(an ``article``, ``main`` or ``h1``) or, outside of one, more paragraphs than controls; a label goes if it is a
control's.  A class or id counts as a name only if all its parts are listed names
or words for a place or box (``sidebar-left``, not ``side-effects`` or ``with-sidebar``), and
not beside a class for the content (``sidebar layout``); never for headings, an article's
header or, but for adverts and comments, paragraphs of an article; never for an element
that holds the article; and one of links (menus, related pages) only if links or the
lack of paragraphs bear it out.  If names would leave no text at all, they do not count.
None of this depends on how much text an element has.

Each page is a row of its own; memory is bounded by a batch of pages.

Defined results: null, empty and text-free pages give an empty text; text
outside any element counts as body text; repeated rows and null urls are kept;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import named, table, text_udf

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",  # with a quote that does not end
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?|[\s=/\"']")

HEAD = frozenset("title meta link style script base noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg annotation annotation-xml object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td"
    " tfoot th thead tr ul".split()
)
# An opening tag ends an open element of these, up to the nearest boundary.
ENDS = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
}
ENDS = {tag: (frozenset(ends.split()), frozenset(until.split())) for tag, (ends, until) in ENDS.items()}
CONTROLS = frozenset("button input select textarea".split())
NOISE = CONTROLS | frozenset("head nav aside footer dialog menu option optgroup datalist legend output meter progress".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
FORMS = frozenset("form fieldset".split())
HEADERS = frozenset("header masthead topbar".split())  # not inside an article
LINKS = frozenset("menu nav navbar navigation breadcrumb breadcrumbs social share sharing related recommended pagination pager".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
ADVERTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion newsletter subscribe signup".split()
)
NAMES = HEADERS | LINKS | COMMENTS | ADVERTS | frozenset(
    "banner cookie cookies consent gdpr notice popup modal overlay sidebar side widget footer login search".split()
)
PLACES = frozenset(  # that a name may stand with
    "left right top bottom upper lower primary secondary first last inner outer container wrapper wrap box block area section"
    " list item items group row col column panel pane slot zone unit bar buttons button links link form site page global"
    " main reader readers user users policy message thread tree children depth even odd by and the".split()
)
CONTENT = frozenset("layout content page main post entry story article".split())  # beside a name: the content, laid out so
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
PROSE = frozenset("p blockquote pre li dt dd td th figure figcaption".split())
LINK_SHARE = 0.3  # of the text of an element named for its links


class Element:
    __slots__ = (
        "tag", "parent", "content", "noise", "names", "control", "chars", "tags", "link_chars", "link_tags", "density", "total",
    )

    def __init__(self, tag: str, parent: Element | None, attributes: str = "") -> None:
        self.tag, self.parent = tag, parent
        self.content: list[Element | str] = []  # in page order
        given = attributes_of(attributes)
        self.noise = parent is not None and is_noise(tag, given, parent)
        self.names = set() if parent is None else noise_names(tag, given, parent)  # that speak for leaving it out
        # A control that is seen, or a label of one.
        self.control = (tag in CONTROLS and given.get("type", "").lower() != "hidden") or (tag == "label" and "for" in given)


def attributes_of(text: str) -> dict[str, str]:
    """Names (lower case) and values in the order of the tag; the first of equal names counts."""
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        if name:
            out.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') else value)
    return out


def is_noise(tag: str, attributes: dict[str, str], inside: Element) -> bool:
    if tag == "footer" and within(inside, ("blockquote",)):
        return False  # says whose words they are
    if tag in NOISE or tag in RAW:
        return True
    if tag == "header" and not within(inside, ("article", "main")):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    return "hidden" in attributes or attributes.get("role", "").lower() in NOISE_ROLES and tag not in FORMS


def noise_names(tag: str, attributes: dict[str, str], inside: Element) -> set[str]:
    """The listed names by which the element's class or id calls the element itself."""
    if tag in HEADINGS or tag in ("html", "body", "main"):
        return set()
    out: set[str] = set()
    for key in ("class", "id"):
        words = [re.split("[-_]+", one) for one in attributes.get(key, "").lower().split()]
        if any(len(parts) == 1 and parts[0] in CONTENT for parts in words):
            return set()
        for parts in words:
            names = NAMES.intersection(parts)
            if names and all(p in NAMES or p in PLACES or p.isdigit() or not p for p in parts):
                out |= names
    if within(inside, ("article", "main")):
        out -= HEADERS
        if tag in PROSE:
            out &= ADVERTS | COMMENTS
    return out if tag != "article" else out & (ADVERTS | COMMENTS | LINKS)


def everything(root: Element) -> list[Element]:
    """All elements, parents first."""
    out = [root]
    for element in out:
        out.extend(c for c in element.content if not isinstance(c, str))
    return out


def judge(root: Element) -> None:
    """Leave out forms, labels and named elements by what they hold."""
    elements = everything(root)
    controls, paragraphs, holds, linked, chars = {}, {}, {}, {}, {}
    for element in reversed(elements):
        below = [c for c in element.content if not isinstance(c, str)]
        key = id(element)
        own = sum(len(" ".join(c.split())) for c in element.content if isinstance(c, str))
        seen = [c for c in below if not c.noise]
        chars[key] = own + sum(chars[id(c)] for c in seen)
        linked[key] = chars[key] if element.tag == "a" else sum(linked[id(c)] for c in seen)
        controls[key] = element.control + sum(controls[id(c)] for c in below)
        paragraphs[key] = (element.tag == "p" and chars[key] > 0 and not controls[key]) + sum(paragraphs[id(c)] for c in below)
        holds[key] = any(holds[id(c)] or c.tag in ("main", "h1") or (c.tag == "article" and not c.names) for c in seen)
        if element.tag in FORMS and not holds[key]:
            inside = within(element, ("article", "main")) is not None
            element.noise = element.noise or inside or paragraphs[key] <= controls[key]
        if element.tag == "label" and controls[key]:
            element.noise = True
    named = []
    for element in elements:
        if element.names and not element.noise and not holds[id(element)]:
            bare = linked[id(element)] >= LINK_SHARE * chars[id(element)] or not paragraphs[id(element)]
            if bare or not element.names <= LINKS:
                element.noise = True
                named.append(element)
    if not any(text.strip() for element in in_order(root) for text in element.content if isinstance(text, str)):
        for element in named:
            element.noise = False


def within(element: Element | None, tags: tuple[str, ...]) -> Element | None:
    while element is not None and element.tag not in tags:
        element = element.parent
    return element


def close(open_: Element, tags, until=frozenset()) -> Element:
    """Where one is after ending the innermost open element of ``tags``, if there
    is one before a boundary in ``until``."""
    at: Element | None = open_
    while at is not None and at.tag not in until:
        if at.tag in tags:
            return at.parent or at
        at = at.parent
    return open_


def parsed(html: str) -> Element:
    """The page's elements under one root, which stands for the body."""
    root = Element("body", None)
    open_, at = root, 0
    while True:
        found = TAG.search(html, at)
        text = html[at : found.start() if found else len(html)]
        if text:
            open_.content.append(unescape(text))
        if found is None:
            judge(root)
            return root
        at = found.end()
        end, tag, attributes = found.group(1, 2, 3) if found[2] else found.group(4, 5, 6)
        if tag is None:
            continue
        tag = tag.lower()
        if open_.tag == "head" and not end and tag not in HEAD:
            open_ = open_.parent or root  # the head ends with the first element that isn't its own
        if tag in ("html", "body"):
            continue
        if end:
            # An inline end tag does not end the block around it.
            open_ = close(open_, (tag,), frozenset() if tag in BLOCK else BLOCK)
            continue
        if tag in BLOCK and tag != "hr":
            open_ = close(open_, ("p",), BLOCK - {"p"})
        if tag in ENDS:
            open_ = close(open_, *ENDS[tag])
        element = Element(tag, open_, attributes)
        open_.content.append(element)
        if tag in RAW and not attributes.endswith("/"):
            closing = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = closing.end() if closing else len(html)
        elif tag not in VOID:
            open_ = element


def children(element: Element) -> list[Element]:
    return [c for c in element.content if not isinstance(c, str) and not c.noise]


def in_order(root: Element) -> list[Element]:
    """Elements without noise, parents first."""
    out, waiting = [], [root]
    while waiting:
        element = waiting.pop()
        out.append(element)
        waiting.extend(reversed(children(element)))
    return out


def measured(elements: list[Element]) -> None:
    """Densities and density sums, from the leaves up."""
    for element in reversed(elements):
        below = children(element)
        element.chars = sum(len(" ".join(c.split())) for c in element.content if isinstance(c, str))
        element.chars += sum(c.chars for c in below)
        element.tags = len(below) + sum(c.tags for c in below)
        element.link_tags = sum(c.link_tags + (c.tag == "a") for c in below)
        element.link_chars = element.chars if element.tag == "a" else sum(c.link_chars for c in below)
    body = elements[0]
    body_links = body.link_chars / max(1, body.chars)
    for element in reversed(elements):
        chars, tags = element.chars, max(1, element.tags)
        links, link_tags = max(1, element.link_chars), max(1, element.link_tags)
        base = log(links / max(1, chars - element.link_chars) * chars + body_links * chars + e)
        element.density = chars / tags * log(max(1.0, chars / links * tags / link_tags)) / log(base) if chars else 0.0
        element.total = sum(c.density for c in children(element))


def topmost(elements: list[Element], chosen: set[int]) -> list[Element]:
    """The chosen elements that stand in no other one."""
    out, covered = [], set()
    for element in elements:
        if element.parent is not None and id(element.parent) in covered:
            covered.add(id(element))
        elif id(element) in chosen:
            covered.add(id(element))
            out.append(element)
    return out


def selected(root: Element) -> list[Element]:
    """Elements whose subtrees make up the main text, in page order."""
    elements = in_order(root)
    measured(elements)
    lead = max(elements, key=lambda x: x.total)  # the first of equals
    bound = within(lead, ("article", "main"))
    if bound is None and not lead.total:
        return [root]
    threshold, at = lead.density, lead.parent
    while at is not None:
        threshold, at = min(threshold, at.density), at.parent
    if bound is not None:
        return topmost(elements, {id(x) for x in elements if x.tag in ("article", "main") and x.density >= threshold})
    best: dict[int, Element] = {}  # largest sum in the subtree of each element
    for element in reversed(elements):
        best[id(element)] = max([element, *(best[id(c)] for c in children(element))], key=lambda x: x.total)
    chosen = {id(best[id(x)]) for x in elements if x is not root and x.density >= threshold} | {id(lead)}
    return topmost(elements, chosen)


def blocks(element: Element) -> list[str]:
    """Text of an element's blocks in page order, white space as one space."""
    out, current = [], []

    def flush() -> None:
        text = " ".join("".join(current).split())
        if text:
            out.append(text)
        current.clear()

    waiting: list[Element | str | None] = [element]
    while waiting:
        item = waiting.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            current.append(item)
        elif item.tag == "br":
            current.append(" ")
        elif not item.noise:
            if item.tag in BLOCK:
                flush()
                waiting.append(None)
            waiting.extend(reversed(item.content))
    flush()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    return "\n\n".join(block for element in selected(parsed(html)) for block in blocks(element))


main_text_of = text_udf(main_text, T.StringType())


def extracted(pages: DataFrame, html_col: str = "html", **keep: str) -> DataFrame:
    """Every page's main text beside the columns ``keep`` (new name=name)."""
    return named(pages, **keep, _html=html_col).select(*keep, main_text_of("_html").alias("text"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    found = extracted(table(spark, sf_dir, "pages"), page_id="page_id", url="url")
    return found.withColumn("n_chars", F.length("text").cast("long"))
