"""Main-text extraction from HTML by text-to-tag ratios of parser events.

The standard library's parser sends start, end and text events; nothing of the markup is kept but, for
each text block ("line"), its text, the tags seen in it and its place among containers. Blocks inside
what is never content (navigation, forms, adverts, ...) are dropped at once. The text-to-tag
ratio of the others is smoothed with a Gaussian kernel in page order and split by a threshold into
two clusters. The content region is the smallest container that holds all blocks of the dense cluster; all its
blocks are returned, short ones and linked ones too (of a whole body, linked ones only between dense ones). Declared article or main elements that hold dense text are
preferred to a guessed region.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by their role in HTML, and words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "head title script style noscript template nav aside footer form button select option textarea input iframe object embed "
    "svg math canvas audio video map dialog menu label fieldset search".split()
)
#: Elements that may hold a whole page, and such that name a part of a page; where no text is left without them, they count.
FORMS = frozenset("form fieldset".split())
PAGE_PARTS = frozenset("nav aside footer menu search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"body", "html", "option", "optgroup", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
FURNITURE = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner sidebar sidenav menu nav navbar "
    "navigation topbar breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices notification alert popup modal "
    "overlay newsletter subscribe subscription signup login paywall social share sharing related recommended recommendations trending popular "
    "comment comments commentlist replies reply disqus respond reactions widget toolbar pagination pager copyright skip search form".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Blocks of text, which hold no region by themselves.
TEXT_BLOCKS = HEADINGS | frozenset("p li dt dd td th tr tbody thead tfoot caption pre blockquote address figcaption legend summary hr option optgroup".split())
#: Names that say how a page is laid out around its furniture, not that something is furniture.
LAYOUT = frozenset("with without has no layout open".split())
#: Classes of the content itself, and what a header of the content is named after.
CONTENT = frozenset("post entry article content main story hentry post-content entry-content article-content article-body post-body story-body main-content".split())
OF_CONTENT = frozenset("post entry article story content".split())
#: Words that only say what part of a page's furniture an element is.
PARTS = frozenset(
    "area bar block body bottom box button buttons card col column container content element entries field frame group heading holder icon icons inner item items label left link links list "
    "message module outer page panel post posts primary region right row secondary section site slot stories story text title toggle top unit wrap wrapper".split()
)
#: What may stand in a head; any other element's start ends it.
OF_HEAD = frozenset("head title meta link base script style noscript template".split())
LEAST = 100
#: What an end tag of these may not close beyond.
SCOPES = frozenset("article aside nav header footer form table td th section main div li ul ol dialog body".split())


def _parts(name: str) -> list[str]:
    """The lower-case words of one class name or id."""
    out: list[str] = []
    word = ""
    for c in name:
        if c.isalnum() and not (c.isupper() and word and word[-1].islower()):
            word += c
        else:
            out.append(word.lower())
            word = c if c.isalnum() else ""
    return [x for x in [*out, word.lower()] if x]


def named_furniture(classes: str | None, element_id: str | None, inside: bool = False, other_than: frozenset = frozenset()) -> bool:
    """Whether an element's class names or id call it page furniture.

    The first or the last word of a name decides: page-footer and comments-list are furniture,
    content-with-sidebar is a layout, and a header of an article belongs to the article. Inside an article, a name that
    only starts like furniture and goes on with a subject, such as social-history, is content. Words in other_than don't count.
    """
    names = [*(classes or "").split(), *([element_id] if element_id else [])]
    if any(x.lower() in CONTENT for x in names):
        return False
    for name in names:
        parts = _parts(name)
        if not parts or LAYOUT & set(parts):
            continue
        found = ({parts[0], parts[-1]} & FURNITURE) - other_than
        if inside and parts[-1] not in FURNITURE and not all(x in FURNITURE or x in PARTS or x.isdigit() for x in parts):
            continue
        if found and not (found == {"header"} and OF_CONTENT & set(parts)):
            return True
    return False


class _Blocks(HTMLParser):
    """Turns events into blocks: [text parts, tags, characters in links, path of containers]."""

    def __init__(self, level: int = 0) -> None:
        """level: 1 takes forms as plain containers, 2 also all that the page calls furniture."""
        super().__init__(convert_charrefs=True)
        self.level = level
        self.forms = 0  # of the open elements that hide text, those that are forms
        self.in_forms = 0  # characters that forms alone hide
        self.blocks: list[tuple[str, int, int, tuple]] = []
        self.stack: list[tuple[str, int, bool]] = []  # tag, element number, furniture
        self.kinds: dict[int, str] = {}
        self.containers: dict[int, str] = {}
        self.number = 0
        self.hidden = 0
        self.links = 0
        self.parts: list[str] = []
        self.tags = 0
        self.link_chars = 0

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((text, self.tags, self.link_chars, tuple(n for t, n, _ in self.stack if t in BLOCK)))
                self.tags = 0
            self.parts = []
        self.link_chars = 0

    def _furniture(self, tag: str, attrs: list) -> bool:
        inside = any(t == "article" for t, _, _ in self.stack)
        if tag in FORMS and self.level == 0:
            return True
        if tag in DROPPED - FORMS and (self.level < 2 or tag not in PAGE_PARTS):
            return True
        if self.level == 2:
            return False
        if tag == "header":
            return not inside
        if not attrs or tag in ("html", "body", "main"):
            return False
        named = dict(attrs)
        style = (named.get("style") or "").replace(" ", "").lower()
        if "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
            return True
        if (named.get("role") or "").lower() in FURNITURE_ROLES or named.get("itemprop") == "comment":
            return True
        return tag not in HEADINGS and named_furniture(named.get("class"), named.get("id"), inside, FORMS if tag in FORMS else frozenset())

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag not in OF_HEAD and self.stack and any(t == "head" for t, _, _ in self.stack):
            self._close("head", frozenset(("html",)))
        # the content ends what was left open before it
        if tag in ("article", "main", "body") and self.hidden:
            self._close("nav", frozenset(("article",)))
            if tag != "article":
                self._open_up()
        if tag in BLOCK:
            if not self.hidden:
                self._flush()
            if tag in CLOSES_P:
                self._close("p", SCOPES)
            if tag == "li":
                self._close("li", frozenset(("ul", "ol", "menu")))
            elif tag in ("dt", "dd"):
                self._close("dt", frozenset(("dl",)))
                self._close("dd", frozenset(("dl",)))
            elif tag in ("td", "th", "tr"):
                for t in ("td", "th") if tag != "tr" else ("td", "th", "tr"):
                    self._close(t, frozenset(("table",)))
        if tag in VOID:
            return
        self.number += 1
        furniture = self._furniture(tag, attrs)
        if furniture and not self.hidden:
            self._flush()
        if tag in ("article", "main") or dict(attrs).get("role") == "main" or dict(attrs).get("itemprop") == "articleBody":
            self.kinds[self.number] = "article" if tag == "article" else "main"
        if tag in BLOCK and tag not in TEXT_BLOCKS:
            self.containers[self.number] = tag
        self.stack.append((tag, self.number, furniture))
        self.hidden += furniture
        self.forms += furniture and tag in FORMS
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def _close(self, tag: str, until: frozenset) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if not self.hidden:
                    self._flush()
                for t, _, furniture in self.stack[i:]:
                    self.hidden -= furniture
                    self.forms -= furniture and t in FORMS
                    self.links -= t == "a"
                del self.stack[i:]
                return
            if self.stack[i][0] in until:
                return

    def _open_up(self) -> None:
        """Furniture around a main element or a body is none, forms apart."""
        for i, (t, n, furniture) in enumerate(self.stack):
            if furniture and t not in FORMS:
                self.stack[i] = (t, n, False)
                self.hidden -= 1

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK and not self.hidden:
            self._flush()
        self._close(tag, frozenset() if tag in SCOPES else SCOPES)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.link_chars += len(data.strip())
        elif self.hidden == self.forms:
            self.in_forms += len(data.strip())

    def finish(self) -> None:
        self.close()
        if not self.hidden:
            self._flush()


def smoothed(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing with the kernel renormalised at the ends."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        weights = [kernel[abs(k - i)] for k in range(lo, hi)]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi], strict=True)) / sum(weights))
    return out


def parsed(html: str, level: int = 0) -> _Blocks:
    parser = _Blocks(level)
    parser.feed(html)
    parser.finish()
    return parser


def extract(html: str, sigma: float = 1.0) -> str:
    """The main text of one page; empty when there is none.

    Where forms hide most of the text they are containers, and where nothing is left the page's own names for its parts
    don't count; such a page needs a block of text of LEAST characters that isn't mostly links.
    """
    page = parsed(html)
    seen = sum(len(b[0]) for b in page.blocks)
    if page.in_forms > 4 * seen + LEAST:
        page = parsed(html, 1)
    if not page.blocks:
        page = parsed(html, 2)
        if not any(len(b[0]) >= LEAST and b[2] <= 0.5 * len(b[0]) for b in page.blocks):
            return ""
    return region_text(page, sigma)


def region_text(parser: _Blocks, sigma: float) -> str:
    """The blocks of the content region, one a line."""
    blocks = parser.blocks
    if not blocks:
        return ""
    ratio = smoothed([len(text) / (1 + tags) for text, tags, _, _ in blocks], sigma)
    mean = sum(ratio) / len(ratio)
    threshold = min(math.sqrt(sum((x - mean) ** 2 for x in ratio) / len(ratio)), mean)
    weight = [len(b[0]) * (r >= threshold) * (b[2] <= 0.5 * len(b[0])) for b, r in zip(blocks, ratio, strict=True)]
    total = sum(weight)
    inside = {kind: {n for n, k in parser.kinds.items() if k == kind} for kind in ("article", "main")}
    for region, least in ((inside["article"], 0.4), (inside["main"], 0.3)):
        if region and total and sum(w for w, b in zip(weight, blocks, strict=True) if region & set(b[3])) >= least * total:
            return "\n".join(b[0] for b in blocks if region & set(b[3]))
    if not total:
        region = inside["article"] or inside["main"]
        return "\n".join(b[0] for b in blocks if (region & set(b[3]) if region else b[2] <= 0.5 * len(b[0])))
    dense = [i for i, w in enumerate(weight) if w]
    common = set.intersection(*(set(blocks[i][3]) for i in dense))
    region_of = max((n for n in common if n in parser.containers), default=None)
    narrow = parser.containers.get(region_of, "body") not in ("body", "html")
    return "\n".join(
        b[0] for i, b in enumerate(blocks) if (region_of is None or region_of in b[3]) and (narrow or b[2] <= 0.5 * len(b[0]) or dense[0] < i < dense[-1])
    )


def _extract_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            texts = [extract(x.as_py()) if x.is_valid and len(x.as_py()) else "" for x in part.column("html")]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*part.schema.names[:-1], "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row; a map without a shuffle.

    Null, empty and text-free pages give an empty text. Repeated rows and null ids are kept as they
    are. Other columns are ignored. Pages of any length are parsed whole.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    schema = f"a {kinds[id_col]}, b {kinds[url_col]}, text string, n_chars long"
    rows = pages.select(F.col(id_col).alias("a"), F.col(url_col).alias("b"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract_rows, schema).toDF(id_col, url_col, "text", "n_chars")
