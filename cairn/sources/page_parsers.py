"""The five page kinds: the elements that matter from one Arrow UDF, then expressions over each page's list of them.

An element carries what lies in it and around it as far as the kinds' rules ask: the first name, text or caption inside, the captions
of the figures around it, the description and the link that belong to it. All are found in one pass over the page, so a page of many
cards costs no more a card than a small one, and pages are read where they lie: nothing is shuffled; what a page says is written once.
``parse`` never fails: a page that breaks a rule of its kind has an ``issue`` and no cards.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit, urlunsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cairn.functions.text import NAME_CAP, TITLE_CAP, bounded_field, collapse_whitespace, path_key, trim_summary, url_host
from cairn.sources.shared import small_batches, written

# fixed values: what marks each kind and its cards
PRODUCT_LINK = "/products/"
SOLUTION_CARD = "pages.solutions-page.benefits."
OVERLAY_LABEL = "See solution about"
PRODUCT_HERO = ("products.", ".sections.hero.title")
SOLUTION_EYEBROW = ("pages.", ".hero.eyebrow")
PRODUCT_USE_CASES = ("products.", ".sections.useCases.items.")
SOLUTION_USE_CASES = ("pages.", ".useCases.items.")
DOCS_BODY = "data-pagefind-body"
CMS = "data-cms-path"
KINDS = ("products-overview", "solutions-overview", "marketing-product", "marketing-solution", "developer-docs")

# fixed values: elements without an end tag, and what a new element closes
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_OWN = frozenset("li dt dd option tr td th".split())
WITH_TEXT = frozenset("title figcaption strong p span".split())
#: Elements that the rules of the kinds ask for, besides those with a content path.
KEPT = frozenset("a figure link meta title".split())

#: tag to text: the element's own, link resolved (null if it can't be). caption to p: the texts of the first such elements inside it;
#: tagline: of the paragraph that follows the first strong's parent. linked: whether a product's link is inside. figures: the places and
#: captions of the figures around it. in_body: whether a body of documentation is around it. about: the text of the next description
#: among its siblings; over: the reference and link of the overlay that is a child of the nearest element around it that has one. first_field, item_title,
#: item_description: of the first element of an item of a content path, the item's last title and description.
ELEMENT = (
    "pos:int,tag:string,cms:string,href:string,rel:string,name:string,content:string,link:string,text:string,caption:string,captioned:boolean,linked:boolean,strong:string,tagline:string,span:string,p:string,"
    "figures:array<struct<pos:int,caption:string>>,in_body:boolean,about:string,over:struct<href:string,link:string>,first_field:boolean,item_title:string,item_description:string"
)
CARD = "struct<group:string,name:string,summary:string,href:string>"
#: How many elements are handed to Spark at once, and how many pages are taken from a batch at once.
ELEMENTS_AT_ONCE, PAGES_AT_ONCE = 20_000, 256

# plain markup, which any reader takes alike: a text, an end, a comment, a declaration, or a start with attributes in plain form
_PLAIN = re.compile(
    r"""(([^<]+)|</([a-zA-Z][-a-zA-Z0-9]*)[ \t\n\r\f]*>|<!--(?!>|->)(?:(?!--)[^<])*-->|<![dD][oO][cC][tT][yY][pP][eE][^<>]*>"""
    r"""|<([a-zA-Z][-a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][-a-zA-Z0-9_:]*(?:=(?:"[^"<>]*"|'[^'<>]*'|[^\s"'=<>`]+))?)*)[ \t\n\r\f]*/?>)"""
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][-a-zA-Z0-9_:]*)(?:=(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
#: Elements whose content is no markup, in some version of the reader.
RAW = frozenset("script style textarea xmp iframe noembed noframes plaintext noscript".split())
_PATH = re.compile(r"/(?:[A-Za-z0-9_-]+/?)*\Z")
_ROOT = re.compile(r"(https?://[A-Za-z0-9.-]+(?::[0-9]+)?)(?:[/?#]|\Z)")


class _Reader(HTMLParser):
    def __init__(self, start, end, data):
        super().__init__(convert_charrefs=True)
        self.handle_endtag, self.handle_data = end, data
        self.handle_starttag = self.handle_startendtag = lambda tag, attrs: start(tag, attrs)


def _read(html: str, start, end, data) -> None:
    """Calls what the elements and texts of a page are for. Plain markup is read by one expression; a page that has anything
    else goes to the reader of Python, whole."""
    found = _PLAIN.findall(html)
    if sum(len(whole) for whole, *_ in found) < len(html) or "\x00" in html or not RAW.isdisjoint({tag.lower() for _, _, _, tag, _ in found}):
        reader = _Reader(start, end, data)
        reader.feed(html)
        reader.close()
        return
    for _, text, ended, tag, attrs in found:
        if text:
            data(unescape(text) if "&" in text else text)
        elif ended:
            end(ended.lower())
        elif tag:
            named = [(n.lower(), q or a or u) for n, q, a, u in _ATTRIBUTE.findall(attrs)] if attrs else ()
            start(tag.lower(), [(n, unescape(x)) for n, x in named] if "&" in attrs else named)


@lru_cache(maxsize=4096)
def _root(base: str) -> str | None:
    found = _ROOT.match(base)
    return found and found[1]


def resolved(href: str, base: str) -> str | None:
    """The link, made absolute; null if it can't be."""
    if _PATH.match(href) and (root := _root(base)):
        scheme, host = root.split("//")
        return f"{scheme}//{host.lower()}{href}"
    try:
        parts = urlsplit(urljoin(base, href.strip()))
        if not parts.scheme or (parts.scheme in ("http", "https") and not parts.hostname):
            return None
        return urlunsplit((parts.scheme, parts.netloc.lower(), parts.path or "/", parts.query, parts.fragment))
    except ValueError:
        return None


_NONE: dict[str, str] = {}


class _Element:
    __slots__ = ("pos", "last", "parent", "tag", "attrs", "texts", "text", "overlay")

    def __init__(self, pos, parent, tag, attrs):
        self.pos, self.last, self.parent, self.tag, self.attrs = pos, pos, parent, tag, attrs
        self.texts = self.text = self.overlay = None


def tree_of(html: str | None) -> list[_Element]:
    """All elements of a page in order. Titles, captions and other short elements, and those with a content path, have texts, without
    scripts and styles."""
    out: list[_Element] = []
    stack: list[_Element] = []
    opened: dict[str, int] = defaultdict(int)  # tags on the stack
    reading: list[list[str]] = []  # the texts of open elements that have one

    def close(depth: int) -> None:
        while len(stack) > depth:
            e = stack.pop()
            e.last = len(out) - 1
            opened[e.tag] -= 1
            if e.texts is not None:
                reading.pop()

    def close_last(tag: str) -> None:
        depth = len(stack) - 1
        while stack[depth].tag != tag:
            depth -= 1
        close(depth)

    def start(tag, attrs):
        if tag in CLOSES_P:
            while opened["p"]:
                close_last("p")
        elif tag in CLOSES_OWN and stack and stack[-1].tag == tag:
            close(len(stack) - 1)
        first = {name: value or "" for name, value in reversed(attrs)} if attrs else _NONE  # of repeated names the first counts
        e = _Element(len(out), stack[-1].pos if stack else -1, tag, first)
        out.append(e)
        if tag in WITH_TEXT or CMS in first:
            e.texts = []
        if tag not in VOID:
            stack.append(e)
            opened[tag] += 1
            if e.texts is not None:
                reading.append(e.texts)

    def end(tag):
        if opened[tag]:
            close_last(tag)

    def data(text):
        if reading and not opened["script"] and not opened["style"]:
            for texts in reading:
                texts.append(text)

    _read(html or "", start, end, data)
    close(0)
    for e in out:
        if e.texts is not None:
            e.text = "".join(e.texts)
    return out


def elements_of(html: str | None, url: str | None) -> list[tuple]:
    """The elements of one page that matter, as ``ELEMENT`` has them. One pass from the end finds what is inside (the next of its sort
    that lies before an element's end) and what follows; one from the start hands on what is around."""
    out, base = tree_of(html), url or ""
    for e in out:
        if e.tag == "link" and e.attrs.get("rel") == "canonical":
            base = resolved(e.attrs.get("href", ""), base) or base
            break

    def link(e):
        return resolved(e.attrs["href"], (url or "") if e.tag == "link" else base) if "href" in e.attrs else None

    inside: dict[int, tuple] = {}
    ahead: dict[str, _Element] = {}  # the nearest element ahead, by tag, and that has a product's link
    said: dict[int, str] = {}  # the nearest description ahead, by its parent
    abouts: dict[int, str | None] = {}
    items: dict[str, list] = {}  # title, description, first element
    for e in reversed(out):
        tag, cms = e.tag, e.attrs.get(CMS)
        if tag in ("figure", "a") or (cms and tag == "p"):
            near = {t: x for t, x in ahead.items() if x.pos <= e.last}
            strong, tagline = near.get("strong"), None
            if strong and strong.parent >= 0:
                after = out[strong.parent].last + 1
                if after < len(out) and out[after].tag == "p" and out[after].parent == out[strong.parent].parent:
                    tagline = out[after].text
            text = lambda t: near[t].text if t in near else None  # noqa: B023, E731
            inside[e.pos] = (text("figcaption"), "figcaption" in near, PRODUCT_LINK in near, strong and strong.text, tagline, text("span"), text("p"))
        if cms is not None:
            if tag == "p" and cms.startswith(SOLUTION_CARD):
                if cms.endswith(".description"):
                    said[e.parent] = e.text
                elif cms.endswith(".title"):
                    abouts[e.pos] = said.get(e.parent)
            item, _, field = cms.rpartition(".")
            if field in ("title", "description"):
                seen = items.setdefault(item, [None, None, None])
                k = field == "description"
                if seen[k] is None:
                    seen[k] = e.text
                seen[2] = e.pos
        if tag == "a":
            label = e.attrs.get("aria-label")
            if label and label.startswith(OVERLAY_LABEL) and e.parent >= 0:
                out[e.parent].overlay = e
            if e.attrs.get("href", "").startswith(PRODUCT_LINK):
                ahead[PRODUCT_LINK] = e
        if tag in ("figcaption", "strong", "span", "p"):
            ahead[tag] = e
    firsts = {pos: (title, about) for title, about, pos in items.values()}
    rows, around = [], [([], False, None)] * len(out)
    outside = ([], False, None)
    for e in out:
        figures, body, over = outside
        if e.parent >= 0:
            box, (figures, body, over) = out[e.parent], around[e.parent]
            if box.tag == "figure":
                figures = [*figures, {"pos": box.pos, "caption": inside[box.pos][0]}]
            body = body or (box.tag == "main" and DOCS_BODY in box.attrs)
            over = box.overlay or over
        around[e.pos] = (figures, body, over)
        cms = e.attrs.get(CMS)
        if e.tag in KEPT or cms is not None:
            get = e.attrs.get
            field = firsts.get(e.pos)
            rows.append((
                e.pos, e.tag, cms, get("href"), get("rel"), get("name"), get("content"), link(e), e.text, *(inside.get(e.pos) or (None, False, False, None, None, None, None)),
                figures, body, abouts.get(e.pos), {"href": over.attrs.get("href"), "link": link(over)} if over and e.pos in abouts else None, field is not None, *(field or (None, None)),
            ))
    return rows


def _batches(schema: StructType, n_columns: int):
    """Adds to the rows of batches (page columns, then html and url) the list of each page's elements."""

    def read(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(schema)
        listed = fields.field(n_columns).type
        kinds = [listed.value_type.field(k) for k in range(listed.value_type.num_fields)]

        def made(pages, lists):
            offsets, ends = [0], 0
            for one in lists:
                ends += len(one)
                offsets.append(ends)
            columns = list(zip(*(e for one in lists for e in one), strict=True)) or [()] * len(kinds)
            values = pa.StructArray.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)], fields=kinds)
            return pa.RecordBatch.from_arrays([*(pages.column(k).cast(fields.field(k).type) for k in range(n_columns)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, type=listed)], schema=fields)

        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                pages = batch.slice(at, PAGES_AT_ONCE)
                lists, begun, held = [], 0, 0
                for k, (html, url) in enumerate(zip(pages.column(n_columns).to_pylist(), pages.column(n_columns + 1).to_pylist(), strict=True)):
                    lists.append(elements_of(html, url))
                    held += len(lists[-1])
                    if held > ELEMENTS_AT_ONCE:
                        yield made(pages.slice(begun, len(lists)), lists)
                        lists, begun, held = [], k + 1, 0
                if lists:
                    yield made(pages.slice(begun, len(lists)), lists)

    return read


def elements(pages: DataFrame, html: str = "_html", url: str = "_url") -> DataFrame:
    """The pages' columns without html, and ``elements``: a list of what ``ELEMENT`` names, empty for null and empty pages."""
    small_batches(pages.sparkSession)
    own = [c for c in pages.columns if c != html]
    fields = [StructField(f.name, f.dataType) for f in pages.select(*own).schema.fields]
    schema = StructType([*fields, StructField("elements", StructType.fromDDL(f"x array<struct<{ELEMENT}>>")["x"].dataType)])
    return pages.select(*own, F.col(html).alias("_read_html"), F.col(url).alias("_read_url")).mapInArrow(_batches(schema, len(own)), schema)


# tests of elements: what the kinds' rules call links, cards and overlays ---------------------------------------------------
def path(e: Column, start: str, end: str = "", within: str = "") -> Column:
    """Whether the content path starts, ends and has inside what it should."""
    test = e["cms"].startswith(start) if start else F.lit(True)
    for one in ([e["cms"].endswith(end)] if end else []) + ([F.contains(e["cms"], F.lit(within))] if within else []):
        test = test & one
    return F.coalesce(test, F.lit(False))


def is_product_link(e: Column) -> Column:
    return (e["tag"] == "a") & F.coalesce(e["href"].startswith(PRODUCT_LINK), F.lit(False))


def is_docs_link(e: Column) -> Column:
    return (e["tag"] == "a") & e["href"].isNotNull() & e["in_body"]


def is_solution_card(e: Column) -> Column:
    return (e["tag"] == "p") & path(e, SOLUTION_CARD, ".title")


def goes(e: Column) -> Column:
    """The link as a card has it: none where the reference is blank."""
    return F.when(collapse_whitespace(e["href"]) != "", e["link"])


def first(test, value: str) -> Column:
    """The value of the first element of the page that passes."""
    return F.get(F.filter("elements", test), F.lit(0))[value]


def source_kind(kind: Column) -> Column:
    """The kind that a source is configured with: both overviews are one."""
    return F.when(kind.isin(*KINDS[:2]), "marketing-overview").otherwise(kind)


# cards of each kind, in their order: group, name, summary, href ------------------------------------------------------------
def _card(name: Column, summary: Column, href: Column, group: Column | None = None) -> Column:
    group = F.lit(None).cast("string") if group is None else group
    return F.struct(group.alias("group"), bounded_field(name, NAME_CAP).alias("name"), F.nullif(trim_summary(summary), F.lit("")).alias("summary"), href.alias("href"))


def product_cards() -> Column:
    """A group for each figure, with its caption; a card without a tagline has a null summary. A figure without cards breaks the
    page: it leaves one without a name."""
    null = F.lit(None).cast("string")
    placed = lambda e, figure: F.struct(figure["pos"].alias("figure"), e["pos"].alias("a"), _card(e["strong"], e["tagline"], goes(e), bounded_field(figure["caption"], NAME_CAP)).alias("card"))
    linked = F.flatten(F.transform(F.filter("elements", lambda e: is_product_link(e) & (F.size(e["figures"]) > 0)), lambda e: F.transform(e["figures"], lambda figure: placed(e, figure))))
    empty = F.transform(F.filter("elements", lambda e: (e["tag"] == "figure") & ~e["linked"]), lambda e: F.struct(e["pos"].alias("figure"), F.lit(-1).alias("a"), _card(null, null, null, bounded_field(e["caption"], NAME_CAP)).alias("card")))
    return F.transform(F.array_sort(F.concat(linked, empty)), lambda x: x["card"])


def solution_cards() -> Column:
    """The link of a card is the overlay anchor of the nearest element around it that has one as its child."""
    return F.transform(F.filter("elements", is_solution_card), lambda e: _card(e["strong"], e["about"], goes(e["over"])))


def use_case_cards(start: str, within: str) -> Column:
    """Cards by the path of their item, in order of appearance; of repeated fields the last counts."""
    return F.transform(F.filter("elements", lambda e: e["first_field"] & path(e, start, within=within)), lambda e: _card(e["item_title"], e["item_description"], F.lit(None).cast("string")))


def docs_cards() -> Column:
    """Links with a span or a paragraph; those with neither are navigation."""
    return F.transform(F.filter("elements", lambda e: is_docs_link(e) & (e["span"].isNotNull() | e["p"].isNotNull())), lambda e: _card(e["span"], e["p"], goes(e)))


def parse(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", configured: str | None = None, partitions: int | None = None) -> DataFrame:
    """key, kind, canonical_url, title, description, solution_name, cards, issue: a row per page. issue is the first rule
    that the page breaks, or null; cards are null where it isn't. ``configured``: a column with the source's kind.
    ``partitions``: deal the pages out first, for tables of few files; else they are read where they lie."""
    own = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(html).alias("_html"), (F.col(configured) if configured else F.lit(None).cast("string")).alias("_configured"))
    rows = elements(own.repartition(partitions) if partitions else own)
    has = lambda test: F.exists("elements", test)
    fits = [
        has(lambda e: (e["tag"] == "figure") & e["captioned"] & e["linked"]), has(is_solution_card), has(lambda e: path(e, *PRODUCT_HERO)), has(lambda e: path(e, *SOLUTION_EYEBROW)), has(is_docs_link),
    ]
    marks = F.array_compact(F.array(*(F.when(fit, name) for fit, name in zip(fits, KINDS, strict=True))))
    canonical = F.get(F.filter("elements", lambda e: (e["tag"] == "link") & F.coalesce(e["rel"] == "canonical", F.lit(False))), F.lit(0))
    heads = rows.withColumn("_marks", marks).select(
        "_key", "_url", "_configured", F.when(F.size("_marks") == 1, F.get("_marks", F.lit(0))).when(F.size("_marks") == 0, "none").otherwise("several").alias("kind"), goes(canonical).alias("canonical_url"),
        bounded_field(first(lambda e: e["tag"] == "title", "text"), TITLE_CAP).alias("title"), F.nullif(trim_summary(first(lambda e: (e["tag"] == "meta") & F.coalesce(e["name"] == "description", F.lit(False)), "content")), F.lit("")).alias("description"),
        bounded_field(first(lambda e: path(e, *SOLUTION_EYEBROW), "text"), NAME_CAP).alias("solution_name"), "elements",
    )
    lists = [product_cards(), solution_cards(), use_case_cards(*PRODUCT_USE_CASES), use_case_cards(*SOLUTION_USE_CASES), docs_cards()]
    chosen = F.coalesce(*(F.when(F.col("kind") == name, listed) for name, listed in zip(KINDS, lists, strict=True)))
    # written, so that no test of what follows reads a page again
    seen = written(heads.withColumn("_cards", chosen.cast(f"array<{CARD}>")).drop("elements"))
    same = lambda u: F.concat(url_host(u), path_key(u))
    uses, overview = F.col("kind").isin(*KINDS[2:4]), F.col("kind") == KINDS[0]
    lacks = lambda field: F.exists("_cards", lambda c: c[field].isNull())
    issue = F.coalesce(
        F.when(F.col("kind").isin("none", "several"), F.concat(F.col("kind"), F.lit(" of the kinds fit"))),
        F.when(F.coalesce(source_kind(F.col("kind")) != F.col("_configured"), F.lit(False)), "not the configured kind"),
        F.when(F.col("canonical_url").isNull(), "no canonical link"),
        F.when(same(F.col("canonical_url")) != same(F.col("_url")), "canonical link of another page"),
        F.when(F.col("title").isNull(), "no title of allowed length"),
        F.when(F.col("description").isNull(), "no description"),
        F.when((F.col("kind") == KINDS[3]) & F.col("solution_name").isNull(), "no solution name"),
        F.when(~uses & (F.size("_cards") == 0), "no cards"),
        F.when(overview & lacks("group"), "figure without a caption"),
        F.when(lacks("name"), "card without a name of allowed length"),
        F.when(~overview & lacks("summary"), "card without a description"),
        F.when(~uses & lacks("href"), "card without a link"),
    )
    return seen.select(
        F.col("_key").alias(key), "kind", "canonical_url", "title", "description", F.when(F.col("kind") == KINDS[3], F.col("solution_name")).alias("solution_name"),
        F.when(issue.isNull(), F.col("_cards")).alias("cards"), issue.alias("issue"),
    )


def cards(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """key, kind, pos, group, name, summary, href: a row per card."""
    # the outer form, since a filter on empty lists would be moved below, where it repeats what makes them
    return parsed.select(key, "kind", F.posexplode_outer("cards").alias("pos", "_c")).where("pos IS NOT NULL").select(key, "kind", "pos", "_c.*")
