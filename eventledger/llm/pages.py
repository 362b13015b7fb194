"""Main text of web pages: site templates counted per host, then page structure.

Every container element of a page gets a hash of its whole subtree. Spark counts, for each
host, on how many different pages a subtree occurs; those on many pages of the host are its
template and go. What is left of the page's article loses the parts that its own markup
names as something else: menus, forms, adverts, comments and the like. A name counts when all
its parts are such words (``cookie-notice``, ``siteHeader``, not ``share-price``), and not
on an element that holds most of the text, links aside, of a page without article or main.

A ``<`` that begins no whole tag is text. A page that ends inside a tag, or inside a script
or another element whose content is no markup, ends there.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventledger.llm.common import long_id, text_tag, written

MIN_PAGES = 5  # a template is on this many different pages of a host
MIN_SHARE = 0.05  # and on this share of them,
MANY_PAGES = 200  # or on so many, however large the host

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HOST = re.compile(r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

RAW = frozenset({"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"})
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset(
    "article aside center details dialog dir div dl fieldset figure footer form header main menu nav ol search section table ul".split()
)
DROPPED = frozenset(
    "head nav header footer aside form menu search dialog noscript template svg math canvas audio video object "
    "button select datalist fieldset map".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big blink cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp "
    "slot small span strike strong sub sup time tt u var".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that, beside a mark, name no content of their own.
FURNITURE = frozenset(
    "area bar block bottom box button buttons container content feed float footer global group holder icon icons inner item "
    "items js left link links list main message module outer page panel posts primary region right row section secondary site "
    "slot small sticky stories text thread tools top unit wrap wrapper".split()
)
#: Words in class, id or role that mark something other than the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs combobox comment commentlist "
    "comments complementary consent contentinfo cookie cookies copyright disqus dialog footer form gdpr header login "
    "masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination "
    "popup promo promoted recommended related replies reply respond search share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar widget widgets".split()
)
_NEAR = 16  # open elements among which an inline element of the same kind is looked for
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}


@dataclass(slots=True)
class Element:
    tag: str
    marked: bool  # its names say that it is not the article
    main: bool  # its role or item property says that it is
    parent: int
    first: int  # chunks [first, last) lie in it
    link: bool = False
    last: int = -1
    code: int = 0
    digest: object = field(default=None, repr=False)


def _is_mark(token: str) -> bool:
    """Whether a name says that its element is not the article."""
    parts = [p.lower() for p in _PARTS.findall(token)]
    return not MARKS.isdisjoint(parts) and all(p in MARKS or p in FURNITURE for p in parts)


def _names(attributes: str) -> tuple[bool, bool]:
    """(marked, main) of an element by its attributes."""
    marked = main = False
    for found in _ATTRIBUTE.finditer(attributes):
        key, value = found[1].lower(), (found[2] or "").strip("\"'")
        if key == "hidden":
            marked = True
        elif key == "itemprop":
            main |= value.lower() == "articlebody"
        elif key == "role" and value.lower() in ("main", "article"):
            main = True
        elif key in ("class", "id", "role"):
            marked |= any(map(_is_mark, value.split()))
        elif key == "aria-label":
            marked |= _is_mark(value)
    return marked, main


def parse(page: str):
    """(chunks, elements): a chunk is text or None for a break between blocks."""
    import xxhash

    chunks: list[str | None] = []
    elements: list[Element] = []
    stack: list[int] = []
    hashers: list[int] = []  # containers among the stack

    def note(text: str) -> None:
        if hashers:
            elements[hashers[-1]].digest.update(text.encode("utf-8", "surrogatepass"))

    def close(depth: int) -> None:
        while len(stack) > depth:
            element = elements[stack.pop()]
            element.last = len(chunks)
            if element.tag in BLOCK:
                chunks.append(None)
            if element.digest is not None:
                hashers.pop()
                element.code = element.digest.intdigest()
                element.digest = None
                if hashers:
                    elements[hashers[-1]].digest.update(element.code.to_bytes(8, "little"))

    def text(piece: str) -> None:
        if piece:
            note(piece)
            chunks.append(html.unescape(piece) if "&" in piece else piece)

    at = 0
    while True:
        token = _TOKEN.search(page, at)
        if token is None:
            text(page[at:])
            break
        text(page[at : token.start()])
        at = token.end()
        raw = token[0]
        if raw.startswith("<![CDATA["):
            continue
        name = token[2] or token[5]
        if not name:
            continue
        closing, tag, attributes = token[1] or token[4], name.lower(), token[3] or token[6] or ""
        if not raw.endswith(">"):
            if tag in BLOCK or tag in DROPPED or tag in VOID or tag in RAW or tag in INLINE:
                break  # the page ends inside a tag
            text(raw)
            continue
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if elements[stack[depth]].tag == tag:
                    close(depth)
                    break
            else:
                if tag in BLOCK:
                    chunks.append(None)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            if not end:
                break
            at = page.find(">", end.end()) + 1 or len(page)
            continue
        marked, main = _names(attributes) if attributes else (False, False)
        marked &= tag not in HEADINGS
        if tag in BLOCK:
            for depth in range(len(stack) - 1, -1, -1):
                above = elements[stack[depth]].tag
                if above == "p":
                    close(depth)
                    break
                if above in BLOCK:
                    break
            if tag in _SIBLINGS:
                same, outer = _SIBLINGS[tag]
                for depth in range(len(stack) - 1, -1, -1):
                    above = elements[stack[depth]].tag
                    if above in same:
                        close(depth)
                        break
                    if above in outer:
                        break
            chunks.append(None)
        elif tag == "br":
            chunks.append(" ")
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "path"):
            note(raw)
            continue
        # Inside a marked inline element those of its kind are kept too, to find its own end.
        nested = tag not in BLOCK and any(elements[i].tag == tag for i in stack[-_NEAR:])
        if tag in BLOCK or tag in DROPPED or marked or nested or tag == "a":
            element = Element(tag, marked, main, stack[-1] if stack else -1, len(chunks), tag == "a")
            if tag in CONTAINER:
                element.digest = xxhash.xxh64()
                hashers.append(len(elements))
            stack.append(len(elements))
            elements.append(element)
        note(raw)
    close(0)
    return chunks, elements


def _mains(elements: list[Element]) -> set[int]:
    """Elements that hold the article, and what they lie in: never template."""
    found = {i for i, e in enumerate(elements) if e.tag in ("article", "main", "body", "html") or e.main}
    for i in list(found):
        while i >= 0 and elements[i].parent not in found:
            i = elements[i].parent
            found.add(i)
    return found


def subtrees(page: str) -> tuple[int, list[int]]:
    """The hash of a page's whole text, and the hashes of the containers that may be template."""
    import xxhash

    chunks, elements = parse(page)
    kept = _mains(elements)
    codes = {e.code for i, e in enumerate(elements) if e.tag in CONTAINER and i not in kept and e.last > e.first}
    text = "\n".join(c for c in chunks if c)
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))), sorted(codes)


def main_text(page: str, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The article's blocks, one a line."""
    chunks, elements = parse(page)
    kept = _mains(elements)
    gone = bytearray(len(chunks))
    inside = [False] * len(elements)  # of something that goes
    heavy = _heaviest(chunks, elements)
    for i, e in enumerate(elements):
        above = e.parent >= 0 and inside[e.parent]
        own = e.tag in DROPPED or e.code in template and e.tag in CONTAINER
        own |= e.marked and e.tag not in ("html", "body") and i not in heavy
        if i in kept and e.tag not in ("article", "main"):
            own = e.tag == "head"  # what the article lies in stays, whatever its names
        elif e.tag in ("article", "main") and i in kept:
            own = e.marked and e.parent >= 0 and any(elements[j].tag in ("article", "main") for j in _above(elements, i))
        inside[i] = above or own
        if own and not above:
            gone[e.first : e.last] = b"\x01" * (e.last - e.first)

    def blocks(first: int, last: int) -> list[str]:
        out, block = [], []
        for i in range(first, last + 1):
            chunk = None if i == last else chunks[i]
            if chunk is None:
                joined = " ".join("".join(block).split())
                if joined:
                    out.append(joined)
                block = []
            elif not gone[i]:
                block.append(chunk)
        return out

    def of_roots(wanted) -> list[str]:
        """Blocks of the topmost elements that are wanted, in page order."""
        out, end = [], -1
        for i, e in enumerate(elements):
            if wanted(e) and not inside[i] and e.first >= end:
                out += blocks(e.first, e.last)
                end = e.last
        return out

    size = lambda found: sum(map(len, found))
    articles = of_roots(lambda e: e.tag == "article")
    mains = of_roots(lambda e: e.main) or of_roots(lambda e: e.tag == "main")
    if articles and 2 * size(articles) >= size(mains):
        return "\n".join(articles)
    return "\n".join(mains or articles or blocks(0, len(chunks)))


def _heaviest(chunks: list[str | None], elements: list[Element]) -> set[int]:
    """Marked elements that hold more than half of the page's text outside of links and of
    elements that go by their tag, on a page that does not say where its article is."""
    if not any(e.marked for e in elements) or any(e.main or e.tag in ("article", "main") for e in elements):
        return set()
    weight = [len(c.strip()) if c else 0 for c in chunks]
    for e in elements:
        if e.link or e.tag in DROPPED:
            weight[e.first : e.last] = [0] * (e.last - e.first)
    upto = [0]
    for w in weight:
        upto.append(upto[-1] + w)
    return {i for i, e in enumerate(elements) if e.marked and 2 * (upto[e.last] - upto[e.first]) > upto[-1]}


def _above(elements: list[Element], i: int):
    while (i := elements[i].parent) >= 0:
        yield i


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _signed(code: int) -> int:
    return code - (1 << 64) if code >> 63 else code


def _subtree_rows(batches):
    import pyarrow as pa
    import xxhash

    for batch in batches:
        out: list[list] = [[] for _ in range(5)]  # every page has a row without a code: it counts
        for key, tag, url, page in zip(*(batch.column(i).to_pylist() for i in range(4))):
            whole, codes = subtrees(page)
            host = _signed(xxhash.xxh64_intdigest(host_of(url)))
            for code in (None, *map(_signed, codes)):
                for column, value in zip(out, (key, tag, host, whole, code)):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(out, kinds)], ["_key", "_tag", "host", "whole", "code"]
        )


def _texts(batches):
    import pyarrow as pa

    for batch in batches:
        names = batch.schema.names
        pages = batch.column(names.index("_html")).to_pylist()
        codes = batch.column(names.index("_codes")).to_pylist()
        texts = [
            "" if page is None else main_text(page, {c & (1 << 64) - 1 for c in template or ()})
            for page, template in zip(pages, codes)
        ]
        kept = [n for n in names if n not in ("_html", "_codes")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(names.index(n)) for n in kept), pa.array(texts, pa.string())], [*kept, "_text"]
        )


def template_subtrees(rows: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, code) of the subtrees on many different pages of a host.

    ``rows`` holds a row per page and subtree, and one without a code for each page. Copies of one page count once, so that an
    article that a site shows at many addresses is not taken for template.
    """
    pages = rows.select("host", "whole").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    seen = rows.where("code IS NOT NULL").select("host", "code", "whole").distinct().groupBy("host", "code").agg(F.count("*").alias("n"))
    return seen.where(F.col("n") >= min_pages).join(pages, "host").where((F.col("n") >= F.col("pages") * min_share) | (F.col("n") >= MANY_PAGES)).select("host", "code")


def extract(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_pages: int = MIN_PAGES,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """(id, url, text, n_chars) of every row, with the names of the input's columns.

    Null or empty html gives an empty text. A null url belongs to the nameless host. Rows
    that repeat are each treated alike. A page without an article, main element or such a
    role is read from its whole body. Other columns are not read.
    """
    rows = pages.select(
        long_id(id_col).alias("_key"), text_tag(html_col).alias("_tag"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html")
    ).where("_html IS NOT NULL")
    found = written(
        rows.mapInArrow(_subtree_rows, "_key long, _tag int, host long, whole long, code long"), "page-subtrees"
    )
    template = template_subtrees(found, min_pages, min_share)
    of_page = found.join(template, ["host", "code"]).groupBy("_key", "_tag").agg(F.collect_set("code").alias("_codes"))
    whole = pages.select(
        F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"),
        long_id(id_col).alias("_key"), text_tag(html_col).alias("_tag"),
    )
    joined = whole.join(of_page, ["_key", "_tag"], "left").drop("_key", "_tag")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema.fields if f.name in ("_id", "_url"))
    done = joined.mapInArrow(_texts, f"{kinds}, _text string")
    return done.select(
        F.col("_id").alias(id_col), F.col("_url").alias(url_col), F.col("_text").alias("text"),
        F.length("_text").cast("long").alias("n_chars"),
    )
