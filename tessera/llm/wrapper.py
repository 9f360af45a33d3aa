"""HTML extraction by inferred wrappers.

Method: union-free regular expressions are inferred for each host.  A page gives a nest of elements and texts; neighbours of
one element are aligned and become a repeated group.  The expressions of same-host pages are then aligned one after
another: what only one of them has becomes optional, what both have is aligned further, and texts that differ become slots,
while a text that all pages have alike stays a constant of the wrapper.

Every page is extracted by matching it against its host's wrapper.  Constants of three pages or more are the template's and
go, as do repeated groups of links and what the names of elements show to be menus, adverts, notices, forms and the like.  A
page that marks its article by element, role or name gives the marked part; there a constant or a group of links is the
template's only if all pages have it that have the part, and a first heading is the article's.  On any other page the text is
where most of what varies lies: from the root down, while one child that isn't a repeated group holds most of it, with the
headings and paragraphs beside it.  Each page is judged by itself, so that no layout loses its text to another one of its host.

Same-host pages are never gathered: each task aligns the pages that it reads, and what tasks found is aligned in rounds of
bounded width.

Defined results: a null or empty page has an empty text; repeated rows give repeated results; a null URL's host is empty
and its pages share a wrapper; markup that doesn't nest is closed where its parent ends; text that looks like a broken tag
stays text; elements nested deeper than ``DEPTH`` belong to the one at that depth, with their texts; a page of any length is
read whole; an empty table gives an empty table; columns beside the id, URL and page are ignored.
"""

from __future__ import annotations

import html
import json
import re
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ROWS, arrow_map, materialize
from tessera.llm.urlfilter import host_of

_ATTRS = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(script|style|template|noscript|svg|iframe|textarea|select|title)\b{_ATTRS}>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9-]*)({_ATTRS})>""",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
#: Numbers of pages in names, which would make each page's elements different ones.
DIGITS = re.compile(r"\d{3,}")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img br".split())
#: Elements that an opening one of the same row closes, up to the nearest container.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("html body article main section div nav aside header footer ul ol dl table tbody thead td th blockquote form figure".split())
#: Blocks end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
BOILER = frozenset("head nav header footer aside form button script style template noscript svg iframe textarea select title menu dialog".split())
BOILER_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|gdpr|menu|nav\w*|sidebar|footer|header|comments?|replies|disqus|respond|share\w*|social|related|newsletter|subscribe|popup|modal|breadcrumbs?|widget|toolbar|login|signup|search)(?:$|[\s_-])",
    re.I,
)
ARTICLE = frozenset(("article", "main"))
ARTICLE_NAMES = re.compile(r"(?:^|[\s_-])(?:article|main|post|entry|story)(?:[\s_-](?:body|content|text))?(?:$|\s)|(?:^|\s)(?:content|contentinfo-main)(?:$|\s)", re.I)
#: Elements of any content; two of them without names are alike only if their contents share something.
PLAIN = frozenset("div section td table tr span center font".split())
#: Elements that the text's part may be inside of.
REGIONS = frozenset("html body main section div table tbody tr td center".split())
#: Levels of an expression; texts below belong to the element at that level.
DEPTH = 64
#: Pages that must have a constant for it to be the template's.
TEMPLATE = 3
#: A child that holds such a part of the text holds the text.
MOST = 0.7
#: Partial wrappers that a task aligns at a time, and hosts that a task holds.
WIDTH, HOSTS = 64, 2000


@lru_cache(maxsize=20_000)
def label(tag: str, attrs: str) -> str:
    """The element's tag and first name, with a mark: ``!`` if they hold what isn't the text, ``*`` if they hold the text."""
    names = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in NAMED.finditer(attrs)} if attrs.strip() else {}
    said = " ".join(names.values())
    if tag in BOILER or names.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog"):
        return tag + "!"
    if tag in ARTICLE or names.get("role", "").lower() in ARTICLE:
        return tag + "*"
    if said and tag not in ("html", "body"):
        if BOILER_NAMES.search(said):
            return tag + "!"
        if ARTICLE_NAMES.search(said):
            return tag + "*"
        return f"{tag}.{DIGITS.sub('0', said.split()[0])}" if said.split() else tag
    return tag


def events(page: str):
    """(kind, label, text) with kind ``<``, ``>`` or ``#``; every opened element is closed, in order."""
    stack: list[tuple[str, str]] = []
    at = 0

    def close(n: int):
        while len(stack) > n:
            yield (">", stack.pop()[1], "")

    for m in TOKEN.finditer(page):
        if m.start() > at:
            yield ("#", "", page[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue  # comments, declarations and raw elements hold no text of the page
        tag = tag.lower()
        if m[2]:
            found = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if found is not None:
                yield from close(found)
            continue
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    yield from close(k)
                    break
                if stack[k][0] in CONTAINERS:
                    break
        name = label(tag, m[4])
        yield ("<", name, "")
        if tag in VOID or m[4].endswith("/") and tag not in CONTAINERS:
            yield (">", name, "")
        else:
            stack.append((tag, name))
    if at < len(page):
        yield ("#", "", page[at:])
    yield from close(0)


# An expression is a list of nodes [label, optional, repeated, children, facts].  A text has the label "#" and the facts
# [hash or 0 if it varies, pages, characters, characters in links, numbers of the page's texts]; other nodes have none.


def tag_of(name: str) -> str:
    return name.rstrip("!*").split(".")[0]


def alike(a: list, b: list) -> bool:
    if a[0] != b[0]:
        return False
    if a[0] not in PLAIN or not a[3] or not b[3]:
        return True
    return not {x[0] for x in a[3]}.isdisjoint(x[0] for x in b[3])


def pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Places of alike nodes in the longest common order: what begins and ends both, then the best of the middle."""
    n, m, lo = len(a), len(b), 0
    while lo < min(n, m) and alike(a[lo], b[lo]):
        lo += 1
    hi = 0
    while hi < min(n, m) - lo and alike(a[n - 1 - hi], b[m - 1 - hi]):
        hi += 1
    out = [(k, k) for k in range(lo)]
    rows, cols = n - lo - hi, m - lo - hi
    if rows and cols:
        same = [[alike(a[lo + i], b[lo + j]) for j in range(cols)] for i in range(rows)]
        best = [[0] * (cols + 1) for _ in range(rows + 1)]
        for i in range(rows - 1, -1, -1):
            for j in range(cols - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if same[i][j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < rows and j < cols:
            if same[i][j]:
                out.append((lo + i, lo + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return [*out, *((n - k, m - k) for k in range(hi, 0, -1))]


def leaves(nodes: list):
    """Texts of an expression."""
    todo = list(nodes)
    while todo:
        x = todo.pop()
        if x[0] == "#":
            yield x
        else:
            todo += x[3]


def joined(a: list, b: list, within: bool) -> list:
    """One node for two alike ones, of one page or of two."""
    if a[0] == "#":
        (h, p, c, k, r), (g, q, d, m, s) = a[4], b[4]
        facts = [h if h == g else 0, max(p, q) if within else p + q, c + d, k + m, r + s]
        return ["#", a[1] or b[1], a[2] or b[2] or within, [], facts]
    return [a[0], a[1] or b[1], a[2] or b[2] or within, align(a[3], b[3], within), None]


def align(a: list, b: list, within: bool = False) -> list:
    """One expression for two: alike nodes in their longest common order are joined, the others become optional."""
    out, i, j = [], 0, 0
    for x, y in [*pairs(a, b), (len(a), len(b))]:
        out += [[*n[:1], True, *n[2:]] for n in (*a[i:x], *b[j:y])]
        if x < len(a):
            out.append(joined(a[x], b[y], within))
        i, j = x + 1, y + 1
    return repeats(out) if within else out


def repeats(nodes: list) -> list:
    """Alike neighbours become a repeated node; then runs of two to four nodes that come again do."""
    out: list = []
    for x in nodes:
        if out and alike(out[-1], x):
            out[-1] = joined(out[-1], x, True)
        else:
            out.append(x)
    for w in (2, 3, 4):
        i = 0
        while i + 2 * w <= len(out):
            if all(alike(x, y) for x, y in zip(out[i : i + w], out[i + w : i + 2 * w])):
                for k in range(w):
                    out[i + k] = joined(out[i + k], out[i + w + k], True)
                del out[i + w : i + 2 * w]
            else:
                i += 1
    return out


class Page:
    """A page's texts and its expression.

    ``texts`` has (text, block, whether a menu or the like holds it, whether an article does); a line break is a text of a
    space that no expression has."""

    def __init__(self, page: str):
        self.texts: list[tuple[str, int, bool, bool]] = []
        self.marked = False
        stack: list[list] = [[]]
        open_: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]
        block = depth = 0
        for kind, name, text in events(page):
            _, boiler, starred, link = open_[-1]
            if kind == "#":
                self.texts.append((text, block, boiler, starred))
                if not boiler and (n := len(text.strip())):
                    h = xxhash.xxh64_intdigest(" ".join(text.split())) >> 1 or 1
                    stack[-1].append(["#", False, False, [], [h, 1, n, n if link else 0, [len(self.texts) - 1]]])
                continue
            tag = tag_of(name)
            if kind == "<":
                depth += 1
                bad = boiler or name.endswith("!")
                starred = starred or name.endswith("*") and not bad
                self.marked = self.marked or starred
                open_.append((name, bad, starred, link or tag == "a"))
                if depth <= DEPTH and not boiler:
                    stack.append([])
            else:
                depth -= 1
                open_.pop()
                if depth < DEPTH and not open_[-1][1]:
                    inner = repeats(stack.pop())
                    stack[-1].append([name, False, False, inner, None])
            if tag == "br":
                self.texts.append((" ", block, False, True))
            elif tag not in INLINE:
                block += 1
        self.expression = repeats(stack[0])

    def join(self, chosen: set[int]) -> str:
        """Blocks of the chosen texts in page order."""
        blocks: dict[int, list[str]] = {}
        for k, (text, block, _, _) in enumerate(self.texts):
            if text == " " or k in chosen:
                blocks.setdefault(block, []).append(html.unescape(text))
        lines = (" ".join("".join(b).split()) for b in blocks.values())
        return "\n".join(x for x in lines if x)

    def marks(self, wrapper: list) -> set[int]:
        """Texts of the marked parts, but for what the wrapper knows as the template's in them."""
        template: set[int] = set()

        def find(own: list, known: list) -> None:
            for i, j in pairs(known, own):
                if own[j][0].endswith("*"):
                    facts = [x[4] for x in leaves(known[i][3])]
                    inside(own[j][3], known[i][3], max([TEMPLATE, *(f[1] for f in facts)]), False)
                elif own[j][0] != "#":
                    find(own[j][3], known[i][3])

        def inside(own: list, known: list, pages: int, repeated: bool) -> None:
            for i, j in pairs(known, own):
                x, w = own[j], known[i]
                if x[0] != "#":
                    if tag_of(x[0]) != "h1":
                        inside(x[3], w[3], pages, repeated or w[2])
                elif w[4][1] >= pages and (w[4][0] or (repeated or w[2]) and w[4][3] == w[4][2]):
                    template.update(x[4][4])

        find(self.expression, wrapper)
        every = {k for k, (text, _, boiler, starred) in enumerate(self.texts) if starred and not boiler}
        left = every - template
        return left if any(self.texts[k][0].strip() for k in left) else every  # nothing varies: pages that are all alike

    def varying(self, wrapper: list) -> set[int]:
        """Texts of the part that holds most of what the wrapper doesn't know as the template's, nor as a group of links."""
        template: set[int] = set()
        weight: dict[int, float] = {}
        again: set[int] = set()  # nodes that repeat in some page

        def judge(own: list, known: list, repeated: bool) -> None:
            held = dict((j, i) for i, j in pairs(known, own))
            for j, x in enumerate(own):
                w = known[held[j]] if j in held else None
                rep = x[2] or bool(w and w[2])
                if rep:
                    again.add(id(x))
                if x[0] == "#":
                    facts = w[4] if w else x[4]
                    links = (rep or repeated) and facts[3] > MOST * facts[2]
                    if links or w and facts[0] and facts[1] >= TEMPLATE:
                        template.update(x[4][4])
                    weight[id(x)] = 0.0 if set(x[4][4]) <= template else float(x[4][2] - x[4][3])
                else:
                    judge(x[3], w[3] if w else [], rep or repeated)
                    weight[id(x)] = sum(weight[id(y)] for y in x[3])

        judge(self.expression, wrapper, False)
        if not sum(weight[id(x)] for x in self.expression):
            template = set()  # nothing varies: pages that are all alike
        region, rest = self.expression, []
        while True:
            total = sum(weight[id(x)] for x in region)
            best = next((x for x in region if total and tag_of(x[0]) in REGIONS and id(x) not in again and weight[id(x)] >= MOST * total), None)
            if best is None:
                break
            rest += [x for x in region if tag_of(x[0]) not in CONTAINERS]  # headings and paragraphs beside it
            region = best[3]
        out: set[int] = set()
        rest += region
        while rest:
            x = rest.pop()
            if x[0] == "#":
                out.update(x[4][4])
            else:
                rest += x[3]
        return out - template


def expression(page: str) -> list:
    """The expression of one page, without the numbers of its texts."""
    return bare(Page(page).expression)


def bare(nodes: list) -> list:
    return [[n[0], n[1], n[2], bare(n[3]), [*n[4][:4], []] if n[4] else None] for n in nodes]


def page_text(page: str, wrapper: list) -> str:
    """The page's text by its host's wrapper."""
    p = Page(page)
    return p.join(p.marks(wrapper) if p.marked else p.varying(wrapper))


def _dumps(wrapper: list) -> str:
    return json.dumps(wrapper, separators=(",", ":"))


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(host, wrapper)``: one expression for each host."""
    out = pa.schema([("host", pa.string()), ("wrapper", pa.string())])

    def rows(found: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"host": list(found), "wrapper": list(map(_dumps, found.values()))}, out)

    def fold(batches):
        found: dict[str, list] = {}
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                b = whole.slice(k, ROWS)
                for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    own = expression(page or "")
                    found[host] = align(found[host], own) if host in found else own
                    if len(found) > HOSTS:
                        yield rows(found)
                        found = {}
        if found:
            yield rows(found)

    def together(t: pa.Table) -> pa.Table:
        one: list | None = None
        for w in sorted(t.column("wrapper").to_pylist()):
            one = json.loads(w) if one is None else align(one, json.loads(w))
        return pa.table({"host": [t.column("host")[0].as_py()], "wrapper": [_dumps(one or [])]}, out)

    parts = materialize(pages.select(host_of(F.col(url_col)).alias("host"), html_col).mapInArrow(fold, "host string, wrapper string"))
    while (most := parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > WIDTH:
        salt = F.pmod(F.xxhash64("wrapper"), F.lit(-(-most * 2 // WIDTH)))
        parts = materialize(parts.withColumn("salt", salt).groupBy("host", "salt").applyInArrow(together, "host string, wrapper string"))
    return parts.groupBy("host").applyInArrow(together, "host string, wrapper string")


@lru_cache(maxsize=2_000)
def _loads(wrapper: str) -> list:
    return json.loads(wrapper)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url_col, text)`` for each row."""
    # read again, so that the join deals both sides out by itself and Spark can split a hot host
    wrappers = materialize(infer(pages, url_col, html_col))
    rows = pages.select(id_col, url_col, html_col, host_of(F.col(url_col)).alias("__host")).join(wrappers.withColumnRenamed("host", "__whost"), F.col("__host") == F.col("__whost"), "left")

    def run(cols):
        return {id_col: cols[id_col], url_col: cols[url_col], "text": [page_text(p or "", _loads(w or "[]")) for p, w in zip(cols[html_col], cols["wrapper"], strict=True)]}

    return arrow_map(rows.select(id_col, url_col, html_col, "wrapper"), run, f"`{id_col}` {dict(pages.dtypes)[id_col]}, `{url_col}` string, text string")
