"""Main text of web pages by site template removal: element subtrees are hashed and counted for each host, and those
that recur on many of its pages are deleted.

A page is parsed into a tree. First pass: every element's subtree gets a hash (tag, class, id and text, digits folded),
and every element whose class or id hints at page furniture (HINTS) a second one of its tag and names alone, its label.
Spark counts the pages of each host that have a hash; exact copies of a page count once, so that copied pages are no
template of their own content. A host's template are the hashes on MIN_PAGES pages or more that are also on a share of
them: BOX_SHARE for boxes of few words outside the article and for labels that say nothing but furniture, SHARE for all
else. Second pass: the host's template reaches each of its pages by a join, and the subtrees and labels in it are
deleted, with what HTML itself says is not the article (menus, headers, footers, asides, forms, scripts, styles, hidden
elements and the like: by tag or role).

Where a page marks its article (article, main), the text is that element's. Recurring boxes (named elements, div,
section) within it go too; its plain paragraphs, headings and lists stay, since passages do recur in articles. Neither
the article nor what it is in is ever template, unless another article is left on the page. A host of fewer than
MIN_PAGES different pages has no template; there, names that say nothing but furniture decide.

Null or empty html: empty text. Null url: the host is "". Very long pages: one page's tree is held at a time. Unclosed
and cut-off tags: open elements end at their parent's end. Ties: a hash exactly on the least share of the pages is
template. Repeated rows: each alike. Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, sized, slices, written

MIN_PAGES, SHARE, BOX_SHARE, BOX_WORDS = 5, 0.2, 0.02, 50
OUT = "page_id long, url string, text string, n_chars long"

# HTML's element names by their part in a page.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template svg math select button canvas object audio video".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_NEVER = frozenset("head nav footer aside form menu dialog fieldset".split()) | _RAW
_ENDS_P = _BLOCK - frozenset("html body".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("table ul ol dl article main section div body html td th".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog toolbar".split())
#: Words of class and id that hint at page furniture, and words that say nothing either way. No hint decides where a
#: host has pages enough to count.
HINTS = frozenset("ad ads advert adverts advertisement adsense sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar widget related recommended share sharing social cookie cookies consent gdpr notice popup modal newsletter subscribe signup login comment comments reply replies disqus pagination pager toolbar".split())
_NEUTRAL = frozenset("site page main top bottom left right box bar block list wrap wrapper container link links area section inner outer global primary secondary form".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
_PARTS = re.compile(r"[-_]+")
_WHITE = re.compile(r"\s+")
_DIGITS = re.compile(r"[0-9]+")


#: What names hint at: furniture among other things, or furniture and nothing else.
WEAK, STRONG = 1, 2


class Element:
    __slots__ = ("tag", "names", "parent", "never", "main", "hint", "parts", "hash", "label", "words", "drop")

    def __init__(self, tag: str, names: str, parent: Element | None, never: bool = False, main: bool = False, hint: int = 0):
        self.tag, self.names, self.parent, self.never, self.main, self.hint = tag, names, parent, never, main, hint
        self.parts: list = []  # texts and elements, in order
        self.hash = self.label = self.words = 0
        self.drop = never


def _attributes(text: str) -> dict[str, str]:
    """Read one after the other, so that a name within a value or another name is none; of equal names the first counts."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text) if text and not text.isspace() else ():
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def hint_of(names: str) -> int:
    found = 0
    for name in names.lower().split():
        parts = [p.strip("0123456789") for p in _PARTS.split(name)]
        if any(p in HINTS for p in parts):
            if all(p in HINTS or p in _NEUTRAL or not p for p in parts):
                return STRONG
            found = WEAK
    return found


def parse(page: str) -> Element:
    root = Element("#root", "", None)
    at, here, n = 0, root, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            here.parts.append(page[at:])
            break
        if m.start() > at:
            here.parts.append(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            up = here
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                here = up.parent
            continue
        if tag in _ENDS_P:  # a block ends an open paragraph, with what is open in it
            up = here
            while up.parent is not None and up.tag != "p" and up.tag not in _SCOPE:
                up = up.parent
            if up.tag == "p":
                here = up.parent
        if tag in _SAME:
            up = here
            while up.parent is not None and up.tag not in _SAME[tag] and (up.tag not in _SCOPE or up.tag in ("td", "th") and tag == "tr"):
                up = up.parent
            while up.tag in _SAME[tag]:
                here, up = up.parent, up.parent
        attributes = _attributes(m[3])
        role, names = attributes.get("role", "").lower(), f"{attributes.get('class', '')} {attributes.get('id', '')}".strip()
        hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        never = tag in _NEVER or role in _ROLES or hidden or tag == "header" and not here.main
        hint = hint_of(names) if names and tag not in ("html", "body") else 0
        element = Element(tag, names, here, never, tag in ("article", "main") or role in ("main", "article"), hint)
        here.parts.append(element)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>|\Z", re.IGNORECASE).search(page, at)
            at = end.end()
        elif tag not in _VOID and not m[3].endswith("/"):
            here = element
    return root


def hashed(root: Element) -> Iterator[tuple[Element, int, float]]:
    """Gives every element the hashes of its subtree and its label; what may be template: the element, the hash, and the
    share of the host's pages that makes it so."""
    stack, order = [(root, False)], []
    holders: set[int] = set()
    while stack:
        e, inside = stack.pop()
        order.append((e, inside))
        if e.main:  # what the article is in holds it
            up = e.parent
            while up is not None and id(up) not in holders:
                holders.add(id(up))
                up = up.parent
        stack += [(x, inside or e.main) for x in e.parts if isinstance(x, Element)]
    for e, inside in reversed(order):
        said = [f"{e.tag}.{e.names}"]
        for x in e.parts:
            if isinstance(x, Element):
                said.append(str(x.hash))
                e.words += x.words
            else:
                words = x.split()
                said.append(_DIGITS.sub("0", " ".join(words)))
                e.words += len(words)
        e.hash = xxhash.xxh64_intdigest("\x1f".join(said)) - (1 << 63)
        if e.tag in ("#root", "html", "body"):
            continue
        if e.hint:
            e.label = xxhash.xxh64_intdigest(f"\x1e{_DIGITS.sub('0', said[0])}") - (1 << 63)
            yield e, e.label, BOX_SHARE if e.hint == STRONG else SHARE
        if e.main or id(e) in holders or not e.parts:
            continue
        box = bool(e.names) or e.tag in ("div", "section")
        if box or not inside:
            yield e, e.hash, BOX_SHARE if box and not inside and e.words < BOX_WORDS else SHARE


def _mains(root: Element, through: bool) -> list[Element]:
    """The outermost article elements that are kept; of article within main, the articles. through: what only hints or
    template would delete does not stand in the way."""
    found, stack = [], [root]
    while stack:
        e = stack.pop()
        if e.never or e.drop and not through:
            continue
        if e.main:
            found += (_mains_of(e, through) if e.tag != "article" else []) or [e]
        else:
            stack += [x for x in reversed(e.parts) if isinstance(x, Element)]
    return found


def _mains_of(e: Element, through: bool) -> list[Element]:
    holder = Element("#part", "", None)
    holder.parts = e.parts
    return [x for x in _mains(holder, through) if x.tag == "article"]


def text_of(root: Element, template: frozenset[int] | None = None) -> str:
    """template: of the page's host; None if it has too few pages for one."""
    for e, h, _ in hashed(root):
        if h in template if template is not None else h == e.label and e.hint == STRONG:
            e.drop = True
    mains = _mains(root, False) or _mains(root, True)
    blocks: list[str] = []
    held: list[str] = []

    def close() -> None:
        line = " ".join(entities.unescape("".join(held)).split())
        if line:
            blocks.append(line)
        held.clear()

    for e in mains:
        e.drop = False
    stack: list = list(reversed(mains or [root]))
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            held.append(x)
        elif x.drop:
            if x.tag in _BLOCK:
                close()
        elif x.tag == "br":
            held.append(" ")
        elif x.tag in _BLOCK or x.main or x.tag == "#root":
            close()
            stack.append(None)
            stack += reversed(x.parts)
        else:
            stack += reversed(x.parts)
    close()
    return "\n".join(blocks)


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def template_hashes(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """host (a hash of it), template: for each host of min_pages different pages its template, as a JSON array. Each
    hash needs a share of the pages, so a host's list is at most a page's elements over the least share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 4 << 20, 1024):
            out: set = set()
            for host, key, page in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html")), strict=True):
                if (host, None, None, key) not in out:  # else a copy
                    out.add((host, None, None, key))
                    out.update((host, h, share, key) for _, h, share in hashed(parse(page or "")))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["host", "hash", "share", "page"])

    seen = pages.select(F.xxhash64(_host(F.col("url"))).alias("host"), F.xxhash64("html").alias("page"), "html").mapInArrow(run, "host long, hash long, share double, page long")
    # counted by (host, hash, page) first, so a host with a third of all pages is spread over all tasks
    counts = written(seen.groupBy("host", "hash", "share").agg(F.count_distinct("page").alias("n")).filter((F.col("n") >= min_pages) | F.col("hash").isNull()), "subtrees")
    sizes = sized(written(counts.filter(F.col("hash").isNull() & (F.col("n") >= min_pages)).select("host", F.col("n").alias("pages")), "hosts"))
    often = counts.filter("hash is not null").join(sizes, "host").filter(F.col("n") >= F.col("pages") * F.col("share")).select("host", "hash")
    told = counts.filter(F.col("hash").isNull() & (F.col("n") >= min_pages)).select("host", F.lit(None).cast("long").alias("hash"))
    return often.unionByName(told).groupBy("host").agg(F.to_json(F.array_sort(F.collect_set("hash"))).alias("template"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, frozenset[int] | None] = (None, None)  # pages of a host often follow one another
        known = {}
        for batch in slices(batches, "html", 4 << 20, 1024):
            texts = []
            for page, told in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), strict=True):
                if told != last[0]:
                    if len(known) > 256:
                        known.clear()
                    if told not in known:
                        known[told] = None if told is None else frozenset(json.loads(told))
                    last = told, known[told]
                texts.append(text_of(parse(page or ""), last[1]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    template = written(template_hashes(pages, min_pages), "template")
    # broadcast only if all lists together are small
    n = template.agg(F.sum(F.length("template"))).first()[0] or 0
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.xxhash64(_host(F.col("url"))).alias("host"))
    return rows.join(F.broadcast(template) if n <= 64 * BROADCAST_ROWS else template, "host", "left").select("page_id", "url", "html", "template").mapInArrow(run, OUT)
