"""Main text of web pages by wrapper induction.

Pages of one host with the same sectioning elements form a group; the group's page of median length is its reference.
Every page is parsed into a DOM tree and aligned with the reference by simple tree matching: the largest set of matched
node pairs that keeps parents and the order of siblings, over whole trees. A block of text then lies in a slot: the
reference's container that its own container matches, and the kinds of elements below that.

Spark counts over all pages of a group what each slot holds. Text that most pages hold in one slot is template; the
rest varies. The wrapper of a group follows from these counts: its region is the innermost container that still holds
most of the varying text, its titles are varying first-level headings beside the way down, and slots that hold links
alone on half of the pages are left out, unless the region is an article element. A page's text is what its slots inside
the region hold, without template lines before its first and after its last varying block (between them they are
headings, by-lines, labels) and without what HTML itself marks as something else (navigation, asides, footers, forms,
hidden parts). A page that matches no region, or that has no host, goes by its own tree, with the same rule for the region.

Groups are only ever aggregated: the tree of a reference meets sums by its own nodes, and a wrapper holds lines and slots
that half of a group's pages have at least, so a host with a third of all pages stays spread over tasks.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: A container is entered while it holds so much of the varying text of the one around it.
REGION_SHARE = 0.5
#: A slot's text is template if so large a share of the group's different pages, and so many of them, hold it.
CONSTANT_SHARE = 0.8
LEAST_CONSTANT = 4
#: Template lines that make up more of a page's region than this are no template: the page is one of many near copies.
MOST_CONSTANT = 0.5
#: Share of linked characters from which on a slot is a list of links.
LINK_SHARE = 0.9
#: Subtree shapes and reference trees that a worker remembers before it starts afresh.
MOST_SHAPES = 200_000
MOST_REFERENCES = 256

# Fixed values of HTML: elements without content, inline elements, elements that close an open one of their kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr br img".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = set("article main section div body html table ul ol dl td th aside header footer nav form blockquote".split())
CLOSED_BY_BLOCK = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
# Elements that are no text, or not the article; elements that hold blocks; those among them that may be a region.
NOT_TEXT = set("script style noscript template head title iframe svg canvas object math".split())
NOT_ARTICLE = set("nav aside footer form button select textarea dialog menu".split())
NOT_ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
CONTAINERS = STOPS | set("#root center figure fieldset details tbody thead tfoot tr".split()) | NOT_ARTICLE
REGIONS = set("html body main article section div center table tbody tr td form".split())
SECTIONS = "header nav main article section aside footer form".split()
# Whole class names or ids of containers for adverts, notices and reader comments, which vary like content does.
NOT_NAMES = set("ad ads advert advertisement sponsored sidebar cookie-banner cookie-notice newsletter comment comments comment-list commentlist respond".split())


class Node:
    __slots__ = ("tag", "names", "out", "parts")

    def __init__(self, tag: str, names: tuple = (), out: bool = False):
        self.tag, self.names, self.out = tag, names, out
        self.parts: list[Node | str] = []


def _is_out(tag: str, told: dict, names: list[str]) -> bool:
    """Whether an element is something else than article text by its own marks."""
    if tag in NOT_ARTICLE or (told.get("role") or "").lower() in NOT_ROLES:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    if "hidden" in told or told.get("aria-hidden") == "true" or "display:none" in (told.get("style") or "").replace(" ", "").lower():
        return True
    return tag in CONTAINERS and not NOT_NAMES.isdisjoint(names)


class _Builder(HTMLParser):
    """A forgiving tree: unclosed elements end where HTML lets them, stray end tags are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.stack = [self.root]
        self.opened: Counter = Counter()

    def _close(self, k: int) -> None:
        for node in self.stack[k:]:
            self.opened[node.tag] -= 1
        del self.stack[k:]

    def handle_starttag(self, tag, attrs):
        stack = self.stack
        closing = CLOSES.get(tag, set()) | ({"p"} if tag in CLOSED_BY_BLOCK else set())
        if closing and any(self.opened[t] for t in closing):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closing:
                    self._close(k)
                    break
                if stack[k].tag in STOPS:
                    break
        if attrs:
            told = dict(attrs)
            names = f"{told.get('class') or ''} {told.get('id') or ''}".lower().split()
            node = Node(tag, tuple(sorted({n.strip("0123456789-_") for n in names} - {""})), _is_out(tag, told, names))
        else:
            node = Node(tag, (), tag in NOT_ARTICLE)
        stack[-1].parts.append(node)
        if tag not in VOID:
            stack.append(node)
            self.opened[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.stack) - 1)

    def handle_endtag(self, tag):
        if not self.opened[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                self._close(k)
                return

    def handle_data(self, data):
        self.stack[-1].parts.append(data)


class Tree:
    """A page's block elements in page order: kinds, children and parents by number; inline elements are transparent."""

    def __init__(self, html: str):
        builder = _Builder()
        builder.feed(html)
        builder.close()
        self.root = builder.root
        self.nodes, self.children, self.parent = [self.root], [[]], [-1]
        self.number = {id(self.root): 0}
        todo = [(part, 0) for part in reversed(self.root.parts) if not isinstance(part, str)]
        while todo:
            node, above = todo.pop()
            if node.tag in NOT_TEXT:
                continue
            if node.tag not in INLINE:
                n = len(self.nodes)
                self.number[id(node)] = n
                self.children[above].append(n)
                self.nodes.append(node)
                self.children.append([])
                self.parent.append(above)
                above = n
            todo += [(part, above) for part in reversed(node.parts) if not isinstance(part, str)]


class Matcher:
    """Simple tree matching; equal subtrees share a number, and scores of pairs of such numbers are remembered."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.kind: list[tuple] = []
        self.below: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.scores: dict[tuple[int, int], int] = {}

    def shapes(self, tree: Tree) -> list[int]:
        out = [0] * len(tree.nodes)
        for i in range(len(tree.nodes) - 1, -1, -1):
            node, below = tree.nodes[i], tuple(out[c] for c in tree.children[i])
            key = (node.tag, node.names, below)
            found = self.known.get(key)
            if found is None:
                found = self.known[key] = len(self.kind)
                self.kind.append((node.tag, node.names))
                self.below.append(below)
                self.size.append(1 + sum(self.size[s] for s in below))
            out[i] = found
        return out

    def score(self, a: int, b: int) -> int:
        """Matched pairs of two subtrees, 0 where their roots differ in kind."""
        if a == b:
            return self.size[a]
        if self.kind[a] != self.kind[b]:
            return 0
        found = self.scores.get((a, b))
        if found is None:
            found = self.scores[a, b] = 1 + sum(s for _, _, s in self.pairs(self.below[a], self.below[b]))
        return found

    def pairs(self, a, b) -> list[tuple[int, int, int]]:
        """(place in a, place in b, score) of the best matching of two rows of shapes that keeps their order."""
        m, n, head, tail = len(a), len(b), 0, 0
        # equal shapes at both ends always belong to a best matching
        while head < min(m, n) and a[head] == b[head]:
            head += 1
        while tail < min(m, n) - head and a[m - 1 - tail] == b[n - 1 - tail]:
            tail += 1
        out = [(i, i, self.size[a[i]]) for i in range(head)]
        left, right = {self.kind[x] for x in a[head : m - tail]}, {self.kind[x] for x in b[head : n - tail]}
        rows = [i for i in range(head, m - tail) if self.kind[a[i]] in right]
        columns = [j for j in range(head, n - tail) if self.kind[b[j]] in left]
        if rows and columns:
            best = np.zeros((len(rows) + 1, len(columns) + 1), np.int64)
            worth = np.array([[self.score(a[i], b[j]) for j in columns] for i in rows], np.int64)
            for x in range(len(rows)):
                # a cell is the best of its row so far, the cell above, and the pair itself behind what precedes both
                best[x + 1, 1:] = np.maximum.accumulate(np.maximum(best[x, 1:], np.where(worth[x] > 0, best[x, :-1] + worth[x], 0)))
            found, x, y = [], len(rows), len(columns)
            while x and y:
                if best[x, y] == best[x - 1, y]:
                    x -= 1
                elif best[x, y] == best[x, y - 1]:
                    y -= 1
                else:
                    x, y = x - 1, y - 1
                    found.append((rows[x], columns[y], int(worth[x, y])))
            out += reversed(found)
        return out + [(m - k, n - k, self.size[a[m - k]]) for k in range(tail, 0, -1)]

    def align(self, first: Tree, second: Tree, a: list[int], b: list[int]) -> dict[int, int]:
        """Number in first of every node of second that is matched; a, b: the trees' shapes."""
        out, todo = {}, [(0, 0)]
        while todo:
            x, y = todo.pop()
            out[y] = x
            left, right = first.children[x], second.children[y]
            todo += [(left[i], right[j]) for i, j, _ in self.pairs([a[c] for c in left], [b[c] for c in right])]
        return out


def _mixed(*parts) -> int:
    return xxhash.xxh3_64_intdigest(repr(parts)) - (1 << 63)


def blocks_of(tree: Tree, matched: dict[int, int]) -> list[tuple[int, int, bool, int, int, bool, str]]:
    """(anchor, slot, first-level heading, characters, linked characters, left out, text) of a page's blocks, in order.

    The anchor is the reference's number of the nearest matched container, the slot adds the kinds below it.
    """
    out: list[tuple] = []
    words: list[str] = []
    counts = [0, 0]
    below: dict[tuple, int] = {}

    def flush(state: tuple) -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            anchor, path, head, left_out = state
            out.append((anchor, _mixed(anchor, path), head, counts[1], counts[0], left_out, text))
        counts[:] = [0, 0]

    state = (0, 0, False, False)
    todo: list = [(part, False) for part in reversed(tree.root.parts)]
    while todo:
        part, link = todo.pop()
        if isinstance(part, str):
            words.append(part)
            n = len(part.strip())
            counts[1] += n
            if link:
                counts[0] += n
            continue
        if isinstance(part, tuple):  # the end of a block
            flush(state)
            state = part
            continue
        if part.tag in NOT_TEXT:
            continue
        if part.tag == "br":
            words.append(" ")
            continue
        if part.tag in INLINE and not part.out:
            link = link or part.tag == "a"
        else:
            flush(state)
            todo.append((state, False))
            anchor, path, head, left_out = state
            at = matched.get(tree.number.get(id(part), -1)) if part.tag in CONTAINERS else None
            if at is None:
                key = (path, part.tag, part.names)
                path = below.get(key)
                if path is None:
                    path = below[key] = _mixed(*key)
            else:
                anchor, path = at, 0
            state = (anchor, path, head or part.tag == "h1", left_out or part.out)
        todo += [(x, link) for x in reversed(part.parts)]
    flush(state)
    return out


def region_of(tree: Tree, text: dict[int, int], marked: bool = False) -> int:
    """Number of the innermost container that holds most of the text; text: characters directly in each container.

    With marked, an only article or main element is entered whatever it holds: a page alone has little text to go by.
    """
    total = [0] * len(tree.nodes)
    for i, n in text.items():
        total[i] += n
    for i in range(len(total) - 1, 0, -1):
        total[tree.parent[i]] += total[i]
    at, todo = 0, True
    while todo and tree.nodes[at].tag != "article":
        inner = _regions_below(tree, at)
        only = [c for c in inner if tree.nodes[c].tag in ("article", "main")]
        best = max(inner, key=lambda c: (total[c], -c), default=at)
        if marked and len(only) == 1 and total[only[0]]:
            at = only[0]
        elif best != at and total[best] and total[best] >= REGION_SHARE * total[at]:
            at = best
        else:
            todo = False
    return at


def _regions_below(tree: Tree, at: int) -> list[int]:
    return [c for c in tree.children[at] if tree.nodes[c].tag in REGIONS and not tree.nodes[c].out]


def _inside(tree: Tree, at: int) -> set[int]:
    found, todo = set(), [at]
    while todo:
        i = todo.pop()
        found.add(i)
        todo += tree.children[i]
    return found


def _containers(tree: Tree, found: set[int]) -> list[int]:
    return sorted(i for i in found if tree.nodes[i].tag in CONTAINERS)


def own_blocks(tree: Tree, blocks: list[tuple]) -> list[bool]:
    """Which blocks of a page, aligned with itself, are content by its own tree alone."""
    text: Counter = Counter()
    for anchor, _, _, n, linked, out, _ in blocks:
        text[anchor] += 0 if out else n - linked
    at = region_of(tree, text, marked=True)
    inside = _inside(tree, at)
    above = set()
    while at > 0:
        at = tree.parent[at]
        above.add(at)
    return [not b[5] and (b[0] in inside or (b[2] and b[0] in above)) for b in blocks]


def main_text(html: str | None) -> str:
    """Main text of a page by its own tree alone, as of pages without a host."""
    tree = Tree(html or "")
    blocks = blocks_of(tree, {i: i for i in range(len(tree.nodes))})
    return "\n".join(b[6] for b, own in zip(blocks, own_blocks(tree, blocks)) if own)


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def group_of(url, html):
    """Host and sectioning elements of a page; null without a host or html."""
    used = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(html), F.lit(rf"<({'|'.join(SECTIONS)})[\s>/]"), F.lit(1))))
    return F.when(F.length(host_of(url)) > 0, F.concat_ws(" ", host_of(url), F.array_join(used, " "), F.when(html.isNull(), F.lit(None)).otherwise(F.lit(""))))


_BLOCK = "struct<anchor:int,slot:long,head:boolean,n:int,linked:int,out:boolean,own:boolean,hash:long,text:string>"


def references(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_group, reference): html of each group's page of median length, the least hash of such; rows (page_group, html)."""
    told = scratch.keep(rows.where("page_group is not null").select("page_group", F.length("html").alias("n"), F.xxhash64("html").alias("mark")))
    middle = told.groupBy("page_group").agg(F.percentile_approx("n", 0.5, 1000).alias("middle"))
    best = F.min(F.struct(F.abs(F.col("n") - F.col("middle")), "mark"))["mark"]
    chosen = scratch.keep(told.join(scratch.keep(middle), "page_group").groupBy("page_group").agg(best.alias("mark")))
    found = rows.withColumn("mark", F.xxhash64("html")).join(chosen, ["page_group", "mark"])
    # several texts of one hash: any one of them, but the same in every attempt
    return scratch.keep(found.groupBy("page_group").agg(F.min("html").alias("reference")))


def aligned(rows: DataFrame) -> DataFrame:
    """rows (page_id, url, page_group, html, reference) as (page_id, url, page_group, mark, blocks).

    Blocks are aligned with the reference, or with the page itself where there is none; mark tells pages with equal
    texts and slots.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(1_000_000)  # scores follow the depth of the trees; frames of Python code lie on the heap
        matcher, known = Matcher(), {}
        for batch in batches:
            marks, found, sizes = [], [], []
            for html, reference in zip(batch.column(3), batch.column(4)):
                if len(matcher.kind) > MOST_SHAPES or len(known) > MOST_REFERENCES:
                    matcher, known = Matcher(), {}
                tree = Tree(html.as_py() or "")
                itself = {i: i for i in range(len(tree.nodes))}
                mine = blocks_of(tree, itself)
                own = own_blocks(tree, mine)
                if reference.is_valid:
                    told = reference.as_py()
                    if told not in known:
                        first = Tree(told)
                        known[told] = first, matcher.shapes(first)
                    first, shapes = known[told]
                    mine = blocks_of(tree, matcher.align(first, tree, shapes, matcher.shapes(tree)))
                hashes = [xxhash.xxh3_64_intdigest(b[6]) - (1 << 63) for b in mine]
                marks.append(_mixed([(b[1], h) for b, h in zip(mine, hashes)]))
                found += [(*b[:6], o, h, b[6]) for b, o, h in zip(mine, own, hashes)]
                sizes.append(len(mine))
            columns = list(zip(*found)) or [()] * len(kinds)
            cells = pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], [n for n, _ in kinds])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.int32()), cells)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(marks, pa.int64()), lists], ["page_id", "url", "page_group", "mark", "blocks"])

    kinds = [("anchor", pa.int32()), ("slot", pa.int64()), ("head", pa.bool_()), ("n", pa.int32()), ("linked", pa.int32()), ("out", pa.bool_()), ("own", pa.bool_()), ("hash", pa.int64()), ("text", pa.string())]
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "page_group", "html", "reference").mapInArrow(run, f"page_id {kind}, url string, page_group string, mark long, blocks array<{_BLOCK}>")


def wrappers(pages: DataFrame, refs: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_group, inside, titles, links, constants) of every group of pages (of aligned); refs as of references.

    inside: containers of the region; titles: slots of headings outside it; links: slots of links inside it; constants:
    (slot, hash) of template lines.
    """
    cells = pages.where("page_group is not null").select("page_group", "mark", F.explode("blocks").alias("b"))
    by = ["page_group", "anchor", "slot", "head", "hash"]
    # equal pages count once, so copies of a page make no template
    once = cells.select("page_group", "mark", *[F.col(f"b.{c}").alias(c) for c in (*by[1:], "n", "linked", "out")]).groupBy("mark", *by)
    once = once.agg(F.sum(F.when(~F.col("out"), F.col("n"))).alias("n"), F.sum(F.when(~F.col("out"), F.col("linked"))).alias("linked"))
    texts = once.groupBy(*by).agg(F.count("*").alias("pages"), F.sum("n").alias("n"), F.sum("linked").alias("linked"))
    group = pages.where("page_group is not null").select("page_group", "mark").distinct().groupBy("page_group").agg(F.count("*").alias("all_pages"))
    group = scratch.keep(group)
    often = F.col("pages") >= F.greatest(F.lit(LEAST_CONSTANT), CONSTANT_SHARE * F.col("all_pages"))
    told = texts.join(group, "page_group").withColumn("constant", often)
    told = scratch.keep(
        told.groupBy("page_group", "all_pages", "anchor", "slot", "head").agg(
            F.sum("pages").alias("seen"),
            F.coalesce(F.sum(F.when(~F.col("constant"), F.col("n"))), F.lit(0)).alias("varying"),
            F.coalesce(F.sum(F.when(~F.col("constant"), F.col("linked"))), F.lit(0)).alias("linked"),
            F.collect_list(F.when(F.col("constant"), F.col("hash"))).alias("hashes"),
        )
    )
    # the tree needs counts by reference node alone, as many as the reference page has nodes
    plain = told.groupBy("page_group", "anchor").agg(F.sum(F.col("varying") - F.col("linked")).alias("plain"))

    def learn(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sys.setrecursionlimit(1_000_000)
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=["page_group", "inside", "held", "above", "marked"])
        tree = Tree(right["reference"].iloc[0])
        at = region_of(tree, {int(i): int(n) for i, n in zip(left["anchor"], left["plain"])})
        inside, marked = _inside(tree, at), tree.nodes[at].tag == "article"
        above = []
        while at > 0:
            at = tree.parent[at]
            above.append(at)
        return pd.DataFrame({"page_group": [right["page_group"].iloc[0]], "inside": [_containers(tree, inside)], "held": [sorted(inside)], "above": [above], "marked": [marked]})

    regions = plain.groupBy("page_group").cogroup(refs.groupBy("page_group")).applyInPandas(learn, "page_group string, inside array<int>, held array<int>, above array<int>, marked boolean")
    regions = scratch.keep(regions)
    # what half of a group's pages have, and lines of CONSTANT_SHARE of them: no more than a few pages hold
    often = F.col("seen") * 2 >= F.col("all_pages")
    rows = told.where(often | (F.size("hashes") > 0)).join(regions.select("page_group", "held", "above", "marked"), "page_group")
    held, varies = F.array_contains("held", F.col("anchor")), often & (F.col("varying") > 0)
    title = F.array_contains("above", F.col("anchor")) & F.col("head") & varies
    # links of an article element are its sources, and a page alone says nothing of its slots
    link = held & varies & ~F.col("marked") & (F.col("all_pages") > 1) & (F.col("linked") >= LINK_SHARE * F.col("varying"))
    fixed = F.transform("hashes", lambda h: F.struct(F.col("slot"), h.alias("hash")))
    found = rows.groupBy("page_group").agg(
        F.collect_list(F.when(title, F.col("slot"))).alias("titles"), F.collect_list(F.when(link, F.col("slot"))).alias("links"),
        F.flatten(F.collect_list(F.when(held, fixed))).alias("constants"),
    )
    empty = F.array().cast("array<long>")
    both = regions.select("page_group", "inside").join(found, "page_group", "left")
    nothing = F.array().cast("array<struct<slot:long,hash:long>>")
    return scratch.keep(both.select("page_group", "inside", F.coalesce("titles", empty).alias("titles"), F.coalesce("links", empty).alias("links"), F.coalesce("constants", nothing).alias("constants")))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages.

    Null html is an empty page; pages with a null url, or one without a host, go by their own tree; an empty text where
    nothing is left. An empty table gives an empty one. Null keys and repeated rows stay (equal pages count once in a
    wrapper), other columns are not read. Pages of any length and depth are read whole.
    """
    scratch = Scratch(pages.sparkSession, "html")
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    rows = rows.withColumn("page_group", group_of(F.col("url"), F.col("html")))
    refs = references(rows, scratch)
    read = scratch.keep(aligned(rows.join(refs, "page_group", "left")))
    told = read.join(wrappers(read, refs, scratch), "page_group", "left")
    inside = lambda b: ~b["out"] & F.array_contains("inside", b["anchor"])
    held = lambda b: inside(b) & ~F.array_contains("links", b["slot"])
    fixed = lambda b: F.array_contains("constants", F.struct(b["slot"].alias("slot"), b["hash"].alias("hash")))
    chars = lambda blocks: F.aggregate(blocks, F.lit(0), lambda n, b: n + b["n"])
    title = lambda b: ~b["out"] & F.array_contains("titles", b["slot"])
    inner = F.filter("blocks", held)
    told = told.withColumns({"inner": inner, "shown": F.filter("blocks", lambda b: held(b) | title(b)), "fixed": chars(F.filter(inner, fixed))})
    # a template line goes at the edges of a page's text; between varying blocks it is a heading, a by-line or a label
    told = told.withColumn("same", F.transform("shown", lambda b: fixed(b) & ~title(b)))
    first = F.array_position("same", F.lit(False))
    last = F.size("same") + 1 - F.array_position(F.reverse("same"), F.lit(False))
    told = told.withColumns({"first": first, "last": last})
    # a page that is template for the most part is one of many near copies, and keeps its lines
    drop = F.col("fixed") <= MOST_CONSTANT * chars(F.col("inner"))
    between = F.filter("shown", lambda b, i: (F.col("first") > 0) & (i + 1 >= F.col("first")) & (i + 1 <= F.col("last")))
    own = F.filter("blocks", lambda b: b["own"])
    kept = F.when(F.size("inner") == 0, own).when(drop, between).otherwise(F.col("shown"))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return told.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
