"""Main text of web pages by the distribution of text over lines.

A page is stripped to lines, one for each block of its layout; what lies inside menus, headers,
footers, sidebars, forms, adverts, notices or comment sections is marked as set aside while
stripping and counts as lines without text, as do lists of links. Lengths are summed over a sliding
window of lines. Where the sum surges, the main text begins; where it dives to nothing, it ends; what
lies between is kept. An article or main element bounds where this is looked for. On a page without one, short
lines that are no sentence, as they stand above and below a text, are no part of it: a run of lines is kept from
its first to its last line that is long, a sentence or a heading before one. Elements that would set aside the
bulk of a page are no clutter; see ``_wrappers``. Time and memory are in proportion to the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Lines of a window, and the code points in it that make a surge.
WINDOW, SURGE = 3, 40

# Elements of HTML by their role.
_BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p
    pre search section summary table tbody td tfoot th thead tr ul""".split())
_RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video select xmp".split())
_ASIDE = frozenset("nav header footer aside form menu dialog button head fieldset search".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert "
                         "alertdialog note tablist toolbar".split())
#: Words of class names and ids that mark what is not the article, and others that may stand beside them in a name: a
#: name such as ``share-price``, with a word of neither kind, marks nothing.
_ASIDE_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion
    promotions banner banners nav navbar navigation menu menus menubar breadcrumb breadcrumbs sidebar sidebars side footer
    header masthead comment comments commentlist disqus respond replies reply cookie cookies consent notice notices gdpr
    popup popups modal overlay newsletter subscribe signup login share sharing social related recommend recommended
    recommendation recommendations widget widgets pagination pager toolbar skip copyright legal disclaimer alert teaser
    teasers""".split())
_BESIDE_WORDS = frozenset("""site page main top bottom left right center upper lower primary secondary global mobile desktop
    sticky fixed floating box boxes bar bars block blocks container wrapper wrap section area region panel group grid row
    column col list item items link links button buttons btn icon icons inner outer content body form field title heading
    label text slot unit zone space frame post posts article articles story stories thread count user users my the a b c
    small large big new our all media network networks policy message messages overlay close open toggle dropdown js is
    dark light sm md lg xl""".split())
_TEASER_WORDS = frozenset("teaser teasers related promo promos sponsored recommended advert ad".split())
#: Class names that tell of the layout around an element, not what is in it.
_LAYOUT_NAME = re.compile(r"(?:^|[_-])(?:has|with|without|no)[_-]|[_-](?:layout|page|wrapper|container|grid|body)$", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: A line that ends like this, marks after it aside, is a sentence.
_SENTENCE = re.compile(r"[.!?:;…。！？][\"'”’»)\]]*$")
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story)(?:$|[\s_-])", re.IGNORECASE)
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.DOTALL | re.VERBOSE)
#: A tag whose quotes do not close.
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_RAW_ONLY = frozenset("script style title textarea iframe noscript xmp".split())
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_SPACES = re.compile(r"\s+")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def _hidden(own: dict[str, str], attributes: str) -> bool:
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$|=)", _ATTRIBUTE.sub(" ", attributes)) or own.get("aria-hidden") == "true"
                or re.search(r"display\s*:\s*none", own.get("style", "")))


class Line(NamedTuple):
    text: str
    aside: int  # number of the innermost open element that sets it aside, -1 if none does
    inside: bool  # of an article or main element
    heading: bool
    links: int  # code points of link text


class Aside:
    """An element that is set aside: for certain or not, the one around it (-1 if none), and the articles and mains in it."""

    def __init__(self, tag: str, certain: bool, around: int) -> None:
        self.tag, self.certain, self.around, self.articles, self.mains = tag, certain, around, 0, 0


def _named_aside(names: str, in_article: bool) -> bool:
    """Whether one of the names is made of words that mark clutter, and of nothing that says otherwise."""
    for name in names.split():
        if _LAYOUT_NAME.search(name) or _MAIN_NAME.search(name):
            continue
        words = [w.lower() for w in _WORDS.findall(name)]
        marks = [w for w in words if w in _ASIDE_WORDS and not (in_article and w == "header")]
        if marks and all(w in _ASIDE_WORDS or w in _BESIDE_WORDS or w.isdigit() for w in words):
            return True
    return False


def _set_aside(tag: str, attributes: str, in_article: bool) -> int:
    """0 if it is not set aside, 1 if it is for its name or as a form, 2 if it is for certain."""
    if tag in _ASIDE:
        # A header inside the article may hold its heading.
        if not (tag == "header" and in_article):
            certain = tag not in ("form", "fieldset")
            return 2 if certain or _hidden(_attributes(attributes), attributes) else 1
        return 0
    if not attributes:
        return 0
    own = _attributes(attributes)
    if _hidden(own, attributes) or own.get("role", "").lower() in _ASIDE_ROLES:
        return 2
    names = own.get("class", "") + " " + own.get("id", "")
    if tag == "article":  # one of several that only point to others
        return int(any(w.lower() in _TEASER_WORDS for w in _WORDS.findall(names)))
    if tag in ("main", "body", "html"):
        return 0
    return int(_named_aside(names, in_article))


def lines_of(page: str) -> tuple[list[Line], list[Aside]]:
    """The page's blocks in order, and the elements that set text aside."""
    lines: list[Line] = []
    asides: list[Aside] = []
    within: list[int] = [-1]  # numbers of those that are open
    endless: set[str] = set()  # raw elements that no tag closes from here on
    parts: list[str] = []
    link_parts: list[str] = []
    open_: list[tuple[str, bool, bool]] = []  # element, set aside, article
    names: Counter[str] = Counter()  # of open elements
    article = 0
    at, end = 0, len(page)

    def flush() -> None:
        text = _SPACES.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            links = len(_SPACES.sub(" ", html.unescape("".join(link_parts))).strip())
            lines.append(Line(text, within[-1], article > 0, any(names[h] for h in _HEADINGS), links))
        link_parts.clear()

    def close(n: int) -> None:
        nonlocal article
        while len(open_) > n:
            name, was_aside, was_article = open_.pop()
            names[name] -= 1
            if was_aside:
                within.pop()
            article -= was_article

    while at < end:
        mark = page.find("<", at)
        if mark < 0:
            mark = end
        parts.append(page[at:mark])
        if names["a"]:
            link_parts.append(page[at:mark])
        if mark == end:
            break
        token = _TOKEN.match(page, mark) or _LOOSE.match(page, mark)
        if token is None:  # a sign that opens nothing is text; a tag that is cut off is not
            cut = re.compile(r"</?[A-Za-z!]").match(page, mark) and page.find(">", mark) < 0
            if not cut:
                parts.append("<")
            at = end if cut else mark + 1
            continue
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            if token[0].startswith("<![CDATA["):
                parts.append(html.escape(token[0][9:-3]))
            continue
        if tag in _RAW and not token[1]:
            stop = None if tag in endless else re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(page, at)
            if stop or tag in _RAW_ONLY:
                at = stop.end() if stop else end
            else:
                endless.add(tag)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _BLOCKS or tag in _ASIDE:
            flush()
        if tag in _VOID:
            continue
        if token[1]:
            # Closes the nearest element of the name, and what was left open inside it.
            if names[tag]:
                close(next(i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == tag))
        elif not token[3].endswith("/") or tag in _BLOCKS or tag in _ASIDE:
            if tag in _BLOCKS:  # a block ends an open paragraph, an item the item before
                for closed in ("p", "li", "dt", "dd", "option"):
                    if open_ and open_[-1][0] == closed and (closed == "p" or closed == tag):
                        close(len(open_) - 1)
            apart = _set_aside(tag, token[3], article > 0)
            own = tag in ("article", "main")
            if own and within[-1] >= 0:
                asides[within[-1]].articles += tag == "article"
                asides[within[-1]].mains += tag == "main"
            open_.append((tag, apart > 0, own))
            names[tag] += 1
            if apart:
                asides.append(Aside(tag, apart == 2, within[-1]))
                within.append(len(asides) - 1)
            article += own
    flush()
    for aside in reversed(asides):  # those inside come after those around them
        if aside.around >= 0:
            asides[aside.around].articles += aside.articles
            asides[aside.around].mains += aside.mains
    return lines, asides


def _wrappers(lines: list[Line], asides: list[Aside]) -> set[int]:
    """Numbers of elements that hold the bulk of the page's text and are forms or hold its article.

    A page with an article outside of such elements has none.
    """
    weight = [0] * len(asides)
    total = 0
    for line in lines:
        if line.inside and line.aside < 0:
            return set()
        own = max(len(line.text) - line.links, 0)
        total += own
        if line.aside >= 0:
            weight[line.aside] += own
    for k in range(len(asides) - 1, -1, -1):
        if asides[k].around >= 0:
            weight[asides[k].around] += weight[k]
    return {k for k, aside in enumerate(asides) if not aside.certain and 2 * weight[k] > total
            and (aside.tag in ("form", "fieldset") or aside.mains or aside.articles == 1)}


def _text_of(run: list[tuple[Line, int]]) -> list[str]:
    """The lines of a run on a page without an article: from the first to the last that is long, a sentence, or a heading
    with such a line after it. A run without such lines is short as a whole.
    """
    full = [line for line, length in run if length]
    thick = [len(line.text) - line.links >= SURGE or bool(_SENTENCE.search(line.text)) and 2 * line.links <= len(line.text)
             for line in full]
    if not any(thick):
        return [line.text for line in full]
    first, last = thick.index(True), len(full) - thick[::-1].index(True)
    while first and full[first - 1].heading:
        first -= 1
    return [line.text for line in full[first:last]]


def _dense(lines: list[Line], asides: list[Aside], free: set[int]) -> list[str]:
    """Lines between surge and dive; elements in ``free`` set nothing aside."""
    blocked: list[bool] = []
    for k, aside in enumerate(asides):
        blocked.append(k not in free or aside.around >= 0 and blocked[aside.around])
    apart = [line.aside >= 0 and blocked[line.aside] for line in lines]
    # An article that is marked as such bounds where text is looked for.
    marked = any(line.inside and not a for line, a in zip(lines, apart))
    n = len(lines)
    looked = [not a and (line.inside or not marked) for line, a in zip(lines, apart)]
    linked = [look and 2 * line.links > len(line.text) and not line.heading for look, line in zip(looked, lines)]
    # A line that is a link counts as a list if the line before or after is one too.
    listed = [linked[i] and (i > 0 and linked[i - 1] or i + 1 < n and linked[i + 1]) for i in range(n)]
    lengths = [len(line.text) if look and not li else 0 for line, look, li in zip(lines, looked, listed)]
    weights = [max(length - line.links, 0) if length else 0 for length, line in zip(lengths, lines)]
    total, sums, mass, masses = 0, [], 0, []
    for i in range(n + WINDOW):  # sum over the lines up to i
        total += (lengths[i] if i < n else 0) - (lengths[i - WINDOW] if i >= WINDOW else 0)
        mass += (weights[i] if i < n else 0) - (weights[i - WINDOW] if i >= WINDOW else 0)
        sums.append(total)
        masses.append(mass)
    runs: list[tuple[int, bool, list[str]]] = []
    i = 0
    while i < n:
        if not sums[i]:
            i += 1
            continue
        stop = i
        while sums[stop]:  # until the window has run empty: the dive
            stop += 1
        # Surge: some window in between holds enough; headings of a marked article need none.
        surge = max(masses[i:stop])
        keep = surge >= SURGE or marked and any(line.heading and length for line, length in zip(lines[i:stop], lengths[i:stop]))
        run = list(zip(lines[i:stop], lengths[i:stop]))
        runs.append((surge, keep, [line.text for line, length in run if length] if marked else _text_of(run)))
        i = stop
    if runs and not any(keep for _, keep, _ in runs):  # a short text: its densest run
        return max(runs, key=lambda run: run[0])[2]
    return [text for _, keep, texts in runs if keep for text in texts]


def extract(page: str | None) -> str:
    """The main text: its blocks joined by blank lines; empty if the page has none."""
    lines, asides = lines_of(page or "")
    kept = _dense(lines, asides, _wrappers(lines, asides))
    if not kept:  # nothing is left: what was set aside for its name alone may be the text
        kept = _dense(lines, asides, {k for k, aside in enumerate(asides) if not aside.certain})
    return "\n\n".join(kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every row; a NULL or empty page has an empty text.

    Repeated rows are repeated in the result, and columns other than ``page_id``, ``url`` and ``html`` are not looked at.
    """
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(value.as_py()) for value in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array(map(len, texts), pa.int64())], names=schema.names)

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
