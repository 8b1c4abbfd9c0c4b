"""HTML extraction with site style trees.

The pages of a host are merged into one tree of whole documents: a node is known by its path of tags and classes (runs
of digits in them are alike) and counts once for each different page. A node's content is the pieces of text that stand
in it directly; where a piece has links, each shows as the directory it points to, for the words of a link speak of
another page. A piece that n of a node's m pages show has the importance 1 - ln n / ln m. A node's presentation is the
sequence of its children; its importance is the entropy of the sequences over the m pages, in units of ln m. A branch's
importance is that of all content below it (weighted by pages) and of all presentation below it, composed bottom up.

What tags, roles and classes say, and whether a node lies beside the page's article or main element, is a prior: it
lowers the branch's importance by the share of its pages that say so. A branch whose words and layout differ on all
pages outweighs names that speak against it. Branches of low importance go from each page, and so do single pieces of
text that nearly all pages of a host repeat at one place. What is left is the text.

A host of few pages says little by itself: its importance and its shares of repeated text are shrunk towards what the
other hosts show at the same path; a path that no other host has is taken for content, unless names speak against it.

Parsing runs in Arrow batches; the tree is counted by DataFrame aggregations over hashes, pre-aggregated, so a host
with a third of all pages is spread like any other. Defined results: null, empty or blank html has empty text;
unclosed and stray tags are repaired as browsers do for the common cases; elements that are not shown (hidden,
aria-hidden, display:none) have no text; a null URL belongs to the host ""; equal pages of a host count once for its
tree; repeated rows are extracted row by row; pages of any length and depth are read whole, by loops without recursion, in time linear in
their length however broken they are;
a branch passes its importance on to its 64 nearest ancestors; columns named in `keep` come through whatever they are
called, but for `text` and `n_chars`, which are the result's; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import settled, small, table
from .url_filter import host_and_path

#: What all hosts show of a path counts as so many further pages of a host.
PRIOR_PAGES = 1.0
LOW_IMPORTANCE = 0.2
LOW_SURPRISE = 0.3  # bits: at the same place on over 81 of 100 pages
CONTENT_SHARE = 0.9
#: What a branch loses of its importance where names, on all its pages, speak against it: one above 0.9 (words that all
#: differ, and a layout that does not stay the same) outweighs them.
NAMED = 0.778
REACH = 64
#: Rules of all hosts up to which they are broadcast.
BROADCAST_RULES = 500_000
#: Nodes remembered by a task before it forgets them all (their ancestors are then told again).
MEMORY = 1_000_000

#: Kinds of counted facts.
PAGE, LAYOUT, TEXT, LINKS, LINKED_TEXT, NAMED_OUT, ABOVE = range(7)

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*"|'[^']*'|[^'">])*+)>""")
_NAME = re.compile(r"</?[a-zA-Z]")
_END_OF_NAME = re.compile(r"[\s/>]")
_MARK = re.compile(r"""["'>]""")
#: Letters within which nearly every tag ends; longer ones are looked up by their marks.
NEAR = 256
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_DIRECTORY = re.compile(r"^[^?#]*/")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript iframe template textarea title noembed noframes".split())
_END_OF_RAW = {tag: re.compile(f"</{tag}", re.IGNORECASE | re.ASCII) for tag in _RAW}
_IN_HEAD = frozenset("base link meta".split()) | _RAW
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag closes an open element of these kinds, up to the elements that hold such content.
_CLOSES = (
    {tag: (("p",), ("button", "td", "th", "table", "body")) for tag in _BLOCK - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt", "body", "html"}}
    | {"li": (("li", "p"), ("ul", "ol", "menu", "td", "body"))}
    | {tag: (("dd", "dt", "p"), ("dl", "td", "body")) for tag in ("dd", "dt")}
    | {tag: (("td", "th", "p"), ("tr", "table", "body")) for tag in ("td", "th")}
    | {"tr": (("tr",), ("table", "body"))}
    | {tag: (("tbody", "thead", "tfoot"), ("table", "body")) for tag in ("tbody", "thead", "tfoot")}
)
_ROOTS = ("article", "main")
_NOISE_TAGS = frozenset("nav footer aside form button select menu dialog head input label".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
_NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu "
    "breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription "
    "signup login comment comments commentlist disqus respond reply replies share sharing social related recommended widget widgets "
    "pagination pager toolbar search form alert".split()
)
_NOT_NAMES = frozenset("with has no without".split())


class Element:
    __slots__ = ("tag", "name", "path", "above", "named_out", "shown", "loose", "inside", "link", "items")

    def __init__(self, tag: str, name: str, above: Element | None):
        self.tag, self.name, self.above = tag, name, above
        self.path = _hash(name, above.path) if above else 0
        self.named_out, self.shown, self.loose, self.link = False, True, False, None
        self.inside = above is not None and (above.inside or above.tag in _ROOTS)
        self.items: list[Element | str] = []


def _hash(text: str, seed: int = 0) -> int:
    """A signed 64-bit hash."""
    import xxhash

    return xxhash.xxh64_intdigest(text, seed & (1 << 64) - 1) - (1 << 63)


def _open(tag: str, attributes: str, above: Element) -> Element:
    got = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes and not attributes.isspace() else {}
    classes = got.get("class", "")
    element = Element(tag, _DIGITS.sub("0", f"{tag}.{classes}" if classes else tag), above)
    element.named_out = tag in _NOISE_TAGS or (tag == "header" and not element.inside)
    if tag not in _ROOTS or tag == "article":
        for name in f"{classes} {got.get('id', '')}".split():
            tokens = {t.lower() for t in _TOKEN.findall(name)}
            if tokens & _NOISE_NAMES and not tokens & _NOT_NAMES:
                element.named_out = True
    if got.get("role", "").lower() in _NOISE_ROLES:
        element.named_out = True
    element.shown = not ("hidden" in got or got.get("aria-hidden", "").lower() == "true" or "display:none" in got.get("style", "").lower().replace(" ", ""))
    if tag == "a" and "href" in got:
        found = _DIRECTORY.match(got["href"])
        element.link = "\u2197" + (found[0] if found else "")
    return element


class Tags:
    """The tags of a page from left to right, in time linear in the page however broken it is.

    A tag ends at the first > outside of quotes. Where it is not near, the end is found along the marks (quotes and >):
    after an opening quote it is where it would be after the closing one, so each mark is looked at once a page.
    """

    def __init__(self, page: str):
        self.page = page
        self.marks: list[int] | None = None
        self.ends: dict[int, int] = {}
        self.no_name_end = (0, -1)
        self.last = page.rfind(">")

    def _end(self, at: int) -> int:
        """The place behind the tag whose attributes begin at `at`; -1 if there is none."""
        page = self.page
        if self.marks is None:
            self.marks = [m.start() for m in _MARK.finditer(page)]
            self.closing = {q: [k for k in self.marks if page[k] == q] for q in "\"'"}
        passed: list[int] = []
        while True:
            k = bisect_left(self.marks, at)
            if k == len(self.marks):
                end = -1
                break
            mark = self.marks[k]
            if (known := self.ends.get(mark)) is not None:
                end = known
                break
            passed.append(mark)
            if page[mark] == ">":
                end = mark + 1
                break
            quotes = self.closing[page[mark]]
            k = bisect_left(quotes, mark + 1)
            if k == len(quotes):
                end = -1
                break
            at = quotes[k] + 1
        for mark in passed:
            self.ends[mark] = end
        return end

    def _name_end(self, at: int) -> int:
        if not self.no_name_end[0] <= at <= self.no_name_end[1]:
            found = _END_OF_NAME.search(self.page, at)
            self.no_name_end = at, found.start() if found else len(self.page)
        return self.no_name_end[1]

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether it closes, name, attributes) of the next tag from `at` on; comments have no name."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if start > self.last:  # only a comment without an end can begin here
                start = page.find("<!--", start)
                return (start, len(page), False, "", "") if start >= 0 else None
            if found := _TAG.match(page, start, start + NEAR):
                return start, found.end(), bool(found[1]), found[2].lower(), found[3]
            after = page[start + 1 : start + 2]
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), False, "", ""
            if after in ("!", "?"):
                end = page.find(">", start)
                if end >= 0:
                    return start, end + 1, False, "", ""
            elif found := _NAME.match(page, start):
                stop = self._name_end(found.end())
                end = self._end(stop) if stop < len(page) else -1
                if end >= 0:
                    return start, end, after == "/", page[found.end() - 1 : stop].lower(), page[stop : end - 1]
            at = start + 1
        return None


def parse(page: str | None) -> Element:
    """The page as a tree; scripts, styles and other raw content are left out."""
    root = Element("html", "", None)
    stack, at, page = [root], 0, page or ""
    tags = Tags(page)
    #: Of each tag: the depths at which it is open.
    depths: dict[str, list[int]] = {}
    nowhere = [0]

    def cut(depth: int) -> None:
        for element in reversed(stack[depth:]):
            depths[element.tag].pop()
        del stack[depth:]

    while at < len(page):
        found = tags.next(at)
        text = page[at : found[0] if found else len(page)]
        if text:
            stack[-1].items.append(text)
        if not found:
            break
        _, at, closes, tag, attributes = found
        if not tag:
            continue
        if closes:
            if depths.get(tag):
                cut(depths[tag][-1])
            continue
        if tag not in _IN_HEAD and depths.get("head"):
            cut(depths["head"][-1])
        if tag in _RAW:
            end = _END_OF_RAW[tag].search(page, at)
            at = (page.find(">", end.end()) + 1 or len(page)) if end else len(page)
            continue
        if tag in ("html", "body"):
            continue
        if closing := _CLOSES.get(tag):
            kinds, stop = closing
            deepest = max((depths.get(k) or nowhere)[-1] for k in kinds)
            if deepest and deepest > max((depths.get(k) or nowhere)[-1] for k in stop):
                cut(deepest)
        if tag in _VOID:
            stack[-1].items.append(" " if tag != "hr" else Element("hr", "hr", stack[-1]))
            continue
        element = _open(tag, attributes, stack[-1])
        stack[-1].items.append(element)
        if not attributes.endswith("/") or tag in _BLOCK:
            depths.setdefault(tag, []).append(len(stack))
            stack.append(element)
    _set_apart(root)
    return root


def _set_apart(root: Element) -> None:
    """Where a page has outermost articles, else main elements: what lies beside them is named out."""
    for tag in _ROOTS:
        found, todo = [], [root]
        while todo:
            here = todo.pop()
            if here.named_out or not here.shown:
                continue
            if here.tag == tag:
                found.append(here)
            else:
                todo.extend(x for x in here.items if isinstance(x, Element))
        if found:
            above, roots = set(), set(found)
            for here in found:
                while (here := here.above) is not None and here not in above:
                    above.add(here)
            for here in above:
                here.loose = True
                for x in here.items:
                    if isinstance(x, Element) and x not in above and x not in roots:
                        x.named_out = True
            return


class Piece(NamedTuple):
    """A run of text that stands in one node: the node, its path, the block it shows in, its raw text, and with links' targets."""

    owner: Element
    path: int
    block: int
    raw: str
    shape: str | None


def pieces(root: Element, gone: Callable[[Element], bool]) -> list[Piece]:
    """The pieces of text in page order, but for branches that are `gone`."""
    out: list[Piece] = []
    parts: list[tuple[str, str | None]] = []
    block = 0

    def flush(owner: Element) -> None:
        if parts:
            raw, path = "".join(t for t, _ in parts), _hash("#text", owner.path) if owner.loose else owner.path
            if raw and not raw.isspace():
                shape = None
                if any(link for _, link in parts):
                    kept: list[str] = []
                    for text, link in parts:
                        if link is None or not kept or kept[-1] != link:
                            kept.append(text if link is None else link)
                    shape = "".join(kept)
                out.append(Piece(owner, path, block, raw, shape))
            elif raw:
                out.append(Piece(owner, path, block, raw, None))  # white space between two pieces of a block
            parts.clear()

    # (element, position of its next item, the node its text belongs to, link around it)
    stack: list[tuple[Element, int, Element, str | None]] = [(root, 0, root, None)]
    while stack:
        here, k, owner, link = stack.pop()
        if k == len(here.items):
            if here is owner:
                flush(owner)
                block += here.tag in _BLOCK
            continue
        stack.append((here, k + 1, owner, link))
        item = here.items[k]
        if isinstance(item, str):
            parts.append((item, link))
        elif item.tag in _BLOCK or item.named_out:
            flush(owner)
            block += item.tag in _BLOCK
            if item.shown and not gone(item):
                stack.append((item, 0, item, item.link or link))
        elif item.shown:
            stack.append((item, 0, owner, item.link or link))
    flush(root)
    return out


def _clean(raw: str) -> str:
    return " ".join(entities.unescape(raw).split())


class Facts(NamedTuple):
    """What a page adds to its host's tree; nodes and values are hashes."""

    page: int
    #: (path, kind, value)
    rows: set[tuple[int, int, int]]
    #: path -> itself and its nearest ancestors
    above: dict[int, list[int]]


def facts(page: str | None) -> Facts:
    rows: set[tuple[int, int, int]] = set()
    layouts: dict[int, set[str]] = {}
    above: dict[int, list[int]] = {}
    used: set[int] = set()
    whole: list[str] = []
    for piece in pieces(parse(page), lambda _: False):
        if not (text := _clean(piece.raw)):
            continue
        whole.append(text)
        if piece.shape is None:
            rows.add((piece.path, TEXT, _hash(text)))
        else:
            rows.add((piece.path, LINKS, _hash(_clean(piece.shape))))
            rows.add((piece.path, LINKED_TEXT, _hash(text)))
        here: Element | None = piece.owner
        if here.loose:
            rows.add((piece.path, NAMED_OUT, 0))
            layouts.setdefault(piece.path, set()).add("")
            above.setdefault(piece.path, [piece.path, *_ancestors(here)][:REACH])
        while here is not None and id(here) not in used:
            used.add(id(here))
            layouts.setdefault(here.path, set()).add(",".join(x.name for x in here.items if isinstance(x, Element)))
            if here.path not in above:
                above[here.path] = _ancestors(here)
            if here.named_out:
                rows.add((here.path, NAMED_OUT, 0))
            here = here.above
    rows.update((path, LAYOUT, _hash("\n".join(sorted(shown)))) for path, shown in layouts.items())
    return Facts(_hash("\n".join(whole)), rows, above)


def _ancestors(element: Element) -> list[int]:
    """The paths of an element and of its nearest ancestors below the root."""
    out: list[int] = []
    here: Element | None = element
    while here is not None and here.above is not None and len(out) < REACH:
        out.append(here.path)
        here = here.above
    return out


class Rules(NamedTuple):
    """What a host's tree says: branches of low importance, branches kept against their names, repeated pieces of text."""

    low: frozenset[int] = frozenset()
    high: frozenset[int] = frozenset()
    texts: frozenset[tuple[int, int]] = frozenset()


def extract(page: str | None, rules: Rules = Rules()) -> str:  # noqa: B008
    """The page's text by `rules`.

    A branch that no rule knows was seen on one page: names alone tell whether it is content.
    """

    def gone(element: Element) -> bool:
        return element.path in rules.low or (element.named_out and element.path not in rules.high)

    out: list[str] = []
    blocks: list[tuple[int, list[str]]] = []
    for piece in pieces(parse(page), gone):
        if piece.owner.loose and (piece.path in rules.low or piece.path not in rules.high):
            continue
        if rules.texts and (piece.path, _hash(_clean(piece.raw))) in rules.texts:
            continue
        if not blocks or blocks[-1][0] != piece.block:
            blocks.append((piece.block, []))
        blocks[-1][1].append(piece.raw)
    for _, parts in blocks:
        if text := _clean("".join(parts)):
            out.append(text)
    return "\n".join(out)


def counted(pages: DataFrame) -> DataFrame:
    """(host, path, kind, value, n): on how many different pages of a host each fact holds, from pages(host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[str, int]] = set()
        for batch in batches:
            rows: list[tuple] = []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                got = facts(page.as_py())
                rows.append((host, got.page, 0, PAGE, 0))
                rows.extend((host, got.page, *x) for x in got.rows)
                for path, chain in got.above.items():
                    if (host, path) not in told:
                        told.add((host, path))
                        rows.extend((host, 0, path, ABOVE, x) for x in chain)
                if len(told) > MEMORY:
                    told.clear()
            types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ["host", "page", "path", "kind", "value"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)], names=names)

    seen = pages.select("host", "html").mapInArrow(run, "host string, page long, path long, kind int, value long").distinct()
    return seen.groupBy("host", "path", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


def importance(counts: DataFrame) -> DataFrame:
    """(host, path, seen, named, value): each node's pages but one, share of pages that name it out, and composed importance."""
    of = lambda *kinds: F.col("kind").isin(*kinds)
    added = lambda chosen, x: F.sum(F.when(chosen, x).otherwise(0.0))
    nln = F.col("n") * F.ln("n")
    nodes = counts.where(of(LAYOUT, TEXT, LINKS, NAMED_OUT)).groupBy("host", "path").agg(
        added(of(LAYOUT), F.col("n")).alias("m"), added(of(LAYOUT), nln).alias("layout_nln"), added(of(NAMED_OUT), F.col("n")).alias("out"),
        added(of(TEXT, LINKS), F.col("n")).alias("shown"), added(of(TEXT, LINKS), nln).alias("shown_nln"),
    )
    many = F.col("m") > 1
    content = F.when(many, F.col("shown") - F.col("shown_nln") / F.ln("m")).otherwise(F.col("shown"))
    layout = F.when(many, F.col("m") - F.col("layout_nln") / F.ln("m")).otherwise(F.col("m"))
    nodes = settled(nodes.select("host", "path", "m", "out", "shown", F.greatest(content, F.lit(0.0)).alias("content"), F.greatest(layout, F.lit(0.0)).alias("layout")))
    above = counts.where(of(ABOVE)).select(F.col("host").alias("h"), F.col("path").alias("below"), F.col("value").alias("top"))
    branch = nodes.join(above, (F.col("host") == F.col("h")) & (F.col("path") == F.col("below"))).groupBy("h", "top").agg(
        F.sum("content").alias("c"), F.sum("shown").alias("s"), F.sum("layout").alias("l"), F.sum("m").alias("of")
    )
    value = CONTENT_SHARE * F.try_divide("c", "s") + (1 - CONTENT_SHARE) * F.try_divide("l", "of")
    branch = branch.where("s > 0").select("h", "top", value.alias("value"))
    return nodes.join(branch, (F.col("host") == F.col("h")) & (F.col("path") == F.col("top"))).select(
        "host", "path", (F.col("m") - 1).alias("seen"), F.least(F.col("out") / F.col("m"), F.lit(1.0)).alias("named"), "value"
    )


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, content, keep) of what to remove, from pages(host, html).

    content is null for whole branches; keep tells branches that stay although their names speak against them.
    """
    counts = settled(counted(pages))
    sizes = small(settled(counts.where(F.col("kind") == PAGE).select(F.col("host").alias("h"), F.col("n").alias("size"))))
    # Of a path that no other host has, names are all that is known before: it is taken for content as far as they let.
    value = with_prior(importance(counts), 1 - F.col("named"))
    shrunk = (F.col("seen") * F.col("value") + PRIOR_PAGES * F.col("prior")) / (F.col("seen") + PRIOR_PAGES)
    low = shrunk * (1 - NAMED * F.col("named")) < LOW_IMPORTANCE
    # A branch of one page that its names take out needs no rule: see extract.
    branches = value.where((low & ((F.col("seen") > 0) | (F.col("named") < 1))) | (~low & (F.col("named") > 0)))
    branches = branches.select("host", "path", F.lit(None).cast("long").alias("content"), (~low).alias("keep"))

    shown = counts.where(F.col("kind").isin(TEXT, LINKED_TEXT)).groupBy("host", "path", F.col("value").alias("content")).agg(F.sum("n").alias("n"))
    shown = shown.join(sizes, F.col("host") == F.col("h")).select("host", "path", "content", F.least("n", "size").alias("n"), "size")
    # The chance that another page of a host has the same text at the path.
    again = shown.groupBy("host", "path").agg(F.max("size").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"))
    again = again.select("host", "path", (F.col("m") - 1).alias("seen"), F.lit(0.0).alias("named"), F.least(F.coalesce(F.try_divide("pairs", F.col("m") * (F.col("m") - 1)), F.lit(0.0)), F.lit(1.0)).alias("value"))
    again = with_prior(again, 0.0).select(F.col("host").alias("ah"), F.col("path").alias("ap"), "prior")
    surprise = lambda prior: -F.log2((F.col("n") + PRIOR_PAGES * prior) / (F.col("size") + PRIOR_PAGES))
    likely = shown.where(surprise(F.lit(1.0)) < LOW_SURPRISE)
    repeated = likely.join(again, (F.col("host") == F.col("ah")) & (F.col("path") == F.col("ap"))).where(surprise(F.col("prior")) < LOW_SURPRISE)
    return settled(branches.unionByName(repeated.select("host", "path", "content", F.lit(False).alias("keep"))))


def with_prior(rows: DataFrame, blank: float | Column) -> DataFrame:
    """`rows(host, path, seen, named, value)` with `prior`: the mean of the other hosts at the path, shrunk towards `blank`.

    Means are weighted by `seen`, the pages of a host that can be compared with a first one.
    """
    rows = settled(rows)
    weighted = F.sum(F.col("seen") * F.col("value"))
    paths = settled(rows.groupBy("path").agg(weighted.alias("all_values"), F.sum("seen").alias("all_seen")).withColumnRenamed("path", "of_path"))
    others = F.col("all_values") - F.col("seen") * F.col("value") + F.lit(PRIOR_PAGES) * blank
    prior = others / (F.col("all_seen") - F.col("seen") + PRIOR_PAGES)
    return rows.join(small(paths), F.col("path") == F.col("of_path")).select("host", "path", "seen", "named", "value", prior.alias("prior"))


def main_text(pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep` with text and n_chars of each page."""
    host, _ = host_and_path(F.col(url))
    rows = pages.select(F.struct(*keep).alias("kept"), host.alias("host"), F.col(html).alias("html"))
    found = style_tree(rows)
    rules = found.groupBy(F.col("host").alias("rule_host")).agg(F.collect_list(F.struct("path", "content", "keep")).alias("rules"))
    if found.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    joined = rows.join(rules, F.col("host") == F.col("rule_host"), "left").select("kept", "host", "html", "rules")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, Rules] = {}
        for batch in batches:
            texts = []
            for host, page, given in zip(batch.column("host").to_pylist(), batch.column("html"), batch.column("rules"), strict=True):
                if host not in made:
                    if len(made) >= 1000:
                        made.clear()
                    got = given.as_py() or ()
                    made[host] = Rules(
                        frozenset(r["path"] for r in got if r["content"] is None and not r["keep"]),
                        frozenset(r["path"] for r in got if r["keep"]),
                        frozenset((r["path"], r["content"]) for r in got if r["content"] is not None),
                    )
                texts.append(extract(page.as_py(), made[host]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("kept"), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=["kept", "text", "n_chars"]
            )

    kind = rows.dtypes[0][1]
    return joined.mapInArrow(run, f"kept {kind}, text string, n_chars long").select("kept.*", "text", "n_chars")


def op4_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of `pages` with the text of its article."""
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
