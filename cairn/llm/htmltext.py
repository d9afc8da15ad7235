"""Main-text extraction by the maximum-scoring run of page tokens.

A page is scanned into words and tags. Each token has a type (a word with the element it stands in, or a tag) and a
weight: the log odds that tokens of this type lie in the content of labelled pages. Outside content, words are mostly in
links, lists and footers, and tags are dense, so tags and such words weigh against a run. One linear scan finds the
contiguous run with the largest sum. The run is then widened to the smallest sectioning element that holds it (the
article, if it lies in one), and what such an element holds of menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments is left out.

Of what lies outside the run, boxes that are mostly links and whose own sum isn't positive are left out too, and so are lines
of links alone in what isn't an article or main: menus that have no name.

A class, id or role marks what is left out if the weights of the parts of one of its tokens, which has a cut word, add up to more than zero
("site-header", "reader-comments"), not if a part tells of the page's state ("no-sidebar"); so does the attribute hidden. Marks never cut html, body, main or article. A marked box
that holds the page's text all the same, by the score of the run with marks unread, is not left out.

Null and empty pages, and pages with no words, have an empty text. Broken markup (unclosed tags, stray closings) is read
as far as it goes; memory and time are linear in the page.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Collection, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed: element names of HTML
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "select", "button", "head", "title")
BOXES = frozenset("html body div section article main nav header footer aside form ul ol dl table figure dialog menu details fieldset".split())
INLINE = frozenset("a abbr b bdi bdo cite code del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr label".split())
CUT = frozenset("nav header footer aside form dialog menu fieldset".split())
#: Words of class, id or role that mark what is not the article.
CUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer header masthead "
    "comment comments respond discussion cookie cookies consent notice notices newsletter subscribe signup popup modal share sharing social related recommended widget toolbar pagination pager skip complementary contentinfo search login disqus adsbygoogle adsense sharethis addthis".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([^<]+|<)", re.S)
#: The same without quotes, for the rest of a page whose quotes don't close: a tag ends at the next '>'.
_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|([^<]+|<)", re.S)
#: End tags of raw elements. What such an element holds is not read as HTML: '<' and '<!--' in a script are its own.
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW if name != "head"}
#: Raw elements that browsers, too, read to the end of the page if they are never closed; others then count as a tag only.
TO_THE_END = frozenset("script style noscript textarea iframe title".split())
#: Marks of reader comments: prose that may outweigh a short article, so they hold unless no other text is found.
DISCUSSION = frozenset("comment comments respond discussion disqus".split())
#: What else the parts of a hyphenated mark may be: "site-header", "comments-area"; not "no-sidebar", "comments-open".
FORM_WORDS = frozenset(
    "site page main global primary secondary tertiary top bottom left right area box bar block wrap wrapper container inner outer content section list item items group panel col column row region zone slot unit link links button buttons menu form field text title message overlay thread template post posts article articles stories".split()
)
#: Parts of a mark that tell of the page's state rather than name the box.
STATE_WORDS = frozenset("no not non without has have with hide hidden show open opened closed close enabled disabled off on toggle toggled is using allow".split())
#: What marks can't cut.
UNMARKED = frozenset("html body main article".split())
#: A marked box is kept if the run in it has so large a sum (some seventeen words of prose), and so many times that of the run without it.
LARGE, TIMES = 50.0, 10.0
_MARK = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|/|=|$)(?!=[\"']?until-found)", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
Token = tuple[str, str, int]


def part_weight(part: str) -> float:
    """What a part of a mark says for cutting: one that only says something about the page undoes a cut word ("no-sidebar",
    "comments-open"), others that aren't known weigh a little against it."""
    return 2.0 if part in CUT_WORDS else 0.0 if part in FORM_WORDS else -3.0 if part in STATE_WORDS else -0.5


def mark_of(attrs: str) -> int:
    """0 if no class, id, role or the attribute hidden marks what is left out, 2 if reader comments, 1 if anything else."""
    found = 1 if _HIDDEN.search(attrs) else 0
    for value in _MARK.findall(attrs):
        for token in value.strip("\"'").lower().split():
            parts = {p for p in _SPLIT.split(token) if p.isalpha()}
            words = parts & CUT_WORDS
            if words and sum(part_weight(p) for p in parts) > 0:
                found = max(found, 2 if words & DISCUSSION else 1)
    return found


class Scan:
    """Blocks of a page in order: (text, path of boxes, whether cut, in a link), and the tags before each."""

    def __init__(self, page: str):
        self.boxes: list[tuple[int, str, bool]] = [(-1, "page", False)]  # parent, name, cut
        self.marks: dict[int, int] = {}  # boxes that only a mark of their own cuts
        self.tokens: list[tuple[str, int, str]] = []  # type, box, text or ""
        here, stack, link, at, unclosed, opened = 0, [0], 0, 0, set(), Counter()
        add, match, last = self.tokens.append, _TOKEN.match, page.rfind(">")
        while at < len(page):
            if at > last and page[at] == "<" and page[at + 1 : at + 2] not in ("!", "?"):
                add(("wa" if link else "w", here, page[at:]))  # no tag ends from here on
                break
            m = match(page, at)
            if m[4] == "<" and match is not _PLAIN.match and page[at + 1 : at + 2].isalpha():
                match = _PLAIN.match  # a tag's quotes run to the end of the page
                m = match(page, at)
            at = m.end()
            close, name, attrs, text = m.groups()
            if text is not None:
                add(("w", here, text) if not link else ("wa", here, text))
                continue
            if name is None:
                continue
            name = name.lower()
            if not close and name in RAW and not attrs.endswith("/"):
                add(("t", here, ""))
                if name in _END and name not in unclosed:
                    end = _END[name].search(page, at)
                    if end:
                        at = end.end()
                    elif name in TO_THE_END:
                        break
                    else:  # none follows later either, so each name is sought in vain once
                        unclosed.add(name)
            elif name in BOXES:
                add(("t", here, ""))
                if not close:
                    mark = mark_of(attrs) if attrs and name not in UNMARKED and name not in CUT else 0
                    cut = self.boxes[here][2] or name in CUT or mark > 0
                    self.boxes.append((here, name, cut))
                    here = len(self.boxes) - 1
                    if mark:
                        self.marks[here] = mark
                    stack.append(here)
                    opened[name] += 1
                else:
                    while opened[name]:  # closes what is open in it as well
                        shut = self.boxes[stack.pop()][1]
                        opened[shut] -= 1
                        here = stack[-1]
                        if shut == name:
                            break
                    link = 0
            elif name in INLINE:
                if name == "a":
                    link = 0 if close else 1
                add(("i", here, ""))
            else:
                add(("h" if name[0] == "h" and name[1:].isdigit() else "t", here, ""))

    def unmark(self, void: Iterable[int]) -> list[tuple[int, str, bool]]:
        """The boxes, as cut without the marks of those in ``void``."""
        marks, boxes = self.marks.keys() - set(void), []
        for b, (parent, name, _) in enumerate(self.boxes):
            boxes.append((parent, name, (parent >= 0 and boxes[parent][2]) or name in CUT or b in marks))
        return boxes

    def typed(self) -> Iterable[tuple[str, int]]:
        """(type, number) of each token: words are counted, by the kind of the box they stand in."""
        for kind, box, text in self.tokens:
            if text:
                n = len(text.split())
                yield (f"{kind}@{'cut' if self.boxes[box][2] else self.boxes[box][1]}", n)
            else:
                yield (f"{kind}@{'cut' if self.boxes[box][2] else 'page'}", 1)


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the largest sum; empty if no score is positive."""
    best, at, total, first, run = 0.0, (0, 0), 0.0, 0, False
    for k, s in enumerate(scores):
        if not run or total <= 0:
            total, first, run = 0.0, k, True
        total += s
        if total > best:
            best, at = total, (first, k + 1)
    return at


def labelled_pages(n: int = 60, seed: int = 5) -> list[tuple[str, str, str]]:
    """Own pages of varied layout with their content marked: (before, content, after)."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9)))
    said = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    links = lambda: "<ul>" + "".join(f'<li><a href="/{word()}">{said(1, 2)}</a></li>' for _ in range(rng.randint(3, 9))) + "</ul>"
    pages = []
    for k in range(n):
        content = f"<h1>{said(4, 9)}</h1>" + "".join(f"<p>{said(8, 90)}{rng.choice(['</p>', '', '<br>'])}" for _ in range(rng.randint(2, 9)))
        box = rng.choice(("article", "main", "div", "section"))
        bar = rng.choice(("nav", "header"))
        before = f"<html><head><title>{said(3, 6)}</title></head><body><{bar}>{links()}{said(1, 4)}</{bar}>"
        before += rng.choice(("", f'<div class="ad">{said(3, 12)}</div>', f"<aside>{said(5, 15)}</aside>", f'<div class="cookie-notice">{said(5, 15)}<button>{word()}</button></div>'))
        after = rng.choice(("", f"<form>{said(1, 4)}</form>", f'<div id="comments"><p>{said(5, 40)}</p><p>{said(5, 40)}</p></div>', f'<div class="sidebar">{links()}</div>'))
        after += f"<footer>{said(3, 12)}</footer></body></html>" if k % 5 else "</body></html>"
        pages.append((f"{before}<{box}>", content, f"</{box}>{after}"))
    return pages


def learn_weights(pages: list[tuple[str, str, str]]) -> dict[str, float]:
    """Log odds that a token of a type is content; smoothed by one token either way. Tags never weigh for a run."""
    inside, outside = Counter(), Counter()
    for before, content, after in pages:
        scan, at = Scan(before + content + after), len(Scan(before).tokens)
        upto = len(Scan(before + content).tokens)
        for k, (kind, n) in enumerate(scan.typed()):
            (inside if at <= k < upto else outside)[kind] += n
    odds = {kind: math.log((inside[kind] + 1) / (outside[kind] + 1)) for kind in inside | outside}
    return {kind: min(odd, 3.0) if kind[0] == "w" else min(odd, -0.1) for kind, odd in odds.items()}


WEIGHTS = learn_weights(labelled_pages())


def weight(kind: str) -> float:
    """A type's weight; for types that no labelled page shows: words 1 (in links -1, in what is cut -3), tags -1."""
    known = WEIGHTS.get(kind)
    if known is None:
        known = (-3.0 if kind.endswith("@cut") else 1.0 if kind.startswith("w@") else -1.0) if kind[0] == "w" else -1.0
    return known


def scored_run(scan: Scan) -> tuple[int, int, list[float], list[int]]:
    """[start, end) of the best run, its tokens' scores and the boxes of its words."""
    scores = [weight(kind) * n for kind, n in scan.typed()]
    start, end = best_run(scores)
    held = [box for _, box, text in scan.tokens[start:end] if text and not scan.boxes[box][2] and not text.isspace()]
    return start, end, scores[start:end], held


def content_run(scan: Scan) -> tuple[int, int, list[int]]:
    """[start, end) of the page's content and the boxes of its words. Marks of boxes that hold most of the run found
    without marks are void, if that run far outweighs the one with them; ``scan.boxes`` is then without these marks."""
    start, end, scores, held = scored_run(scan)
    marked, least = scan.boxes, max(LARGE, TIMES * sum(scores))
    for level in (1, 2):
        unread = [b for b, mark in scan.marks.items() if mark <= level]
        if not unread or (level == 2 and held):
            break
        scan.boxes = scan.unmark(unread)
        first, last, scores, _ = scored_run(scan)
        if sum(scores) >= least:
            within = [0.0] * len(scan.boxes)
            for (_, box, text), score in zip(scan.tokens[first:last], scores, strict=True):
                within[box] += score if text else 0.0
            for b in range(len(within) - 1, 0, -1):
                within[scan.boxes[b][0]] += within[b]
            void = [b for b in unread if within[b] >= max(least, within[0] / 2)]
            scan.boxes = scan.unmark(void)
            first, last, scores, words = scored_run(scan)
            if void and words and sum(scores) >= least:
                return first, last, words
        scan.boxes = marked
    return start, end, held


def main_text(page: str | None) -> str:
    if not page:
        return ""
    scan = Scan(page)
    start, end, held = content_run(scan)
    boxes, tokens = scan.boxes, scan.tokens
    if not held:
        return ""

    # boxes are numbered as they open, so the box that holds all is the one that holds the first and the last
    one, two = min(held), max(held)
    while one != two:
        if one > two:
            one = boxes[one][0]
        else:
            two = boxes[two][0]
    common = []
    while one >= 0:
        common.append(one)
        one = boxes[one][0]
    common.reverse()
    named = [b for b in common if boxes[b][1] in ("article", "main")]
    top = named[-1] if named else next((b for b in reversed(common) if boxes[b][1] not in ("ul", "ol", "table", "dl", "figure")), 0)
    lists = linked_boxes(scan, start, end)
    inside = [False] * len(boxes)
    for b, (parent, _, cut) in enumerate(boxes):
        inside[b] = not cut and (b == top or (parent >= 0 and inside[parent] and not lists[b]))
    return blocks(tokens, inside, set() if named else loose_links(scan, start, end, top))


def linked_boxes(scan: Scan, start: int, end: int) -> list[bool]:
    """Of each box whether it is a menu without the name of one: no token of the run lies in it, its own sum isn't positive, and
    half of its words at least are in links."""
    n = len(scan.boxes)
    total, words, links, run = [0.0] * n, [0] * n, [0] * n, [False] * n
    for k, ((_, box, text), (kind, count)) in enumerate(zip(scan.tokens, scan.typed(), strict=True)):
        total[box] += weight(kind) * count
        if text:
            words[box] += count
            links[box] += count * kind.startswith("wa@")
        run[box] |= start <= k < end and bool(text) and not text.isspace()
    for b in range(n - 1, 0, -1):
        up = scan.boxes[b][0]
        total[up] += total[b]
        words[up] += words[b]
        links[up] += links[b]
        run[up] |= run[b]
    return [not run[b] and total[b] <= 0 and 0 < words[b] <= 2 * links[b] for b in range(n)]


def loose_links(scan: Scan, start: int, end: int, top: int) -> set[int]:
    """The texts before or behind the run, in ``top`` or a box that holds words of the run, of lines that are links only: menus without a
    box of their own. A line lies between two tags that part words."""
    holds = {top}
    for _, box, text in scan.tokens[start:end]:
        while text and not text.isspace() and box >= 0 and box not in holds:
            holds.add(box)
            box = scan.boxes[box][0]
    found: set[int] = set()
    line: list[int] = []
    plain = False
    for k, (kind, box, text) in enumerate([*scan.tokens, ("t", -1, "")]):
        if text:
            line.append(k)
            plain |= kind != "wa" and not text.isspace()
        elif kind != "i":
            if not plain:
                found.update(x for x in line if scan.tokens[x][1] in holds and not start <= x < end)
            line, plain = [], False
    return found


def blocks(tokens: list[tuple[str, int, str]], inside: list[bool], without: Collection[int] = ()) -> str:
    """The text of tokens in the boxes ``inside`` but those in ``without``: inline tags join words, all others part them."""
    parts: list[str] = []
    for k, (kind, box, text) in enumerate(tokens):
        if text:
            if inside[box] and k not in without:
                parts.append(entities.unescape(text))
        elif kind != "i":
            parts.append(" ")
    return " ".join("".join(parts).split())


def visible_text(page: str | None) -> str:
    """All text of a page but scripts, styles and the like: what a conversion record holds."""
    if not page:
        return ""
    scan = Scan(page)
    return blocks(scan.tokens, [True] * len(scan.boxes))


def extract(pages: DataFrame, html: str = "html", keep: Iterable[str] = ("page_id", "url")) -> DataFrame:
    """The columns in ``keep``, ``text`` and ``n_chars`` of each row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    keep = list(keep)
    out = T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    arrow = to_arrow_schema(out)

    def run(batches):
        for b in batches:
            texts = [main_text(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=arrow)

    return pages.select(F.col(html), *(F.col(c) for c in keep)).mapInArrow(run, out)
