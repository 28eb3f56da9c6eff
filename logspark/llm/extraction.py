"""Main text of web pages by wrapper induction.

All different pages of a host name its layouts: pages with other tag paths have another layout, and the page with the
most elements is its reference (pages of more than four times the host's mean come last, so that no freak is one while
others will do). Every page of the host is then aligned to the reference
of its layout by simple tree matching (the largest set of element pairs that keeps parents, tags and order), and
the texts at each reference node are counted over all different pages. Nodes that carry the same text in nearly
all of them are constant: they are the host's template. The nodes whose text varies are slots. A page loses what
matches its layout's constants; the slots are content.

Alignment alone cannot tell an advert that changes from page to page from an article, and says nothing on hosts with
few pages. So what an element says of itself counts as well: navigation, headers, footers, asides, forms, scripts,
styles, and elements whose class, id or role names such a part or reader comments, are no content; main elements and
the articles outside them, where there are any, are read in page order. A class, id or role is not asked where the
element holds more text than all slots outside it; reader comments stay out in any case. Where the constants of a layout hold more than a bounded
part of its content, near copies of one page may have outvoted the others: the pages that agree with the constants in
most of their text are left out and the rest is counted again. Fewer than four different pages are no evidence.

Text: character references are decoded, white space within a block becomes one space, blocks are joined by one space.
Nulls and empty pages give an empty text; a null url has a host of its own. Repeated rows give repeated results.
Extra columns pass through. Broken mark-up is read as far as it goes: open elements end with their parents, and an
unclosed comment or script hides the rest of the page.
"""

import html as references
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from logspark.llm.frames import light, runs, stored, unused

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>?""", re.DOTALL)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true)""", re.IGNORECASE)

# Element kinds of HTML, and words by which pages name the parts that are not content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY_BLOCK = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = frozenset("ul ol dl table select article section div body html".split())
NOT_CONTENT = frozenset("nav footer aside form script style noscript template svg iframe object button select textarea input dialog menu head title".split())
PART_NAMES = frozenset(
    "nav navbar navigation menu menubar header masthead footer sidebar aside ad ads advert adverts advertisement advertising banner "
    "promo promotion sponsor sponsored cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended breadcrumb breadcrumbs pagination pager widget widgets "
    "comment comments commentlist disqus replies respond contentinfo complementary search alert toolbar skip".split()
)


@dataclass
class Node:
    tag: str
    names: str = ""
    hidden: bool = False
    kids: list = field(default_factory=list)  # nodes and texts

    def elements(self) -> list["Node"]:
        return [k for k in self.kids if isinstance(k, Node)]

    def own_text(self) -> str:
        return " ".join(" ".join(k for k in self.kids if isinstance(k, str)).split())


def parse(page: str) -> Node:
    """The element tree; texts are decoded. Raw elements keep no text."""
    root = Node("#page")
    stack = [root]
    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        lt = end if lt < 0 else lt
        if lt > at:
            text = page[at:lt]
            stack[-1].kids.append(references.unescape(text) if "&" in text else text)
        if lt == end:
            break
        m = _TOKEN.match(page, lt)
        if m is None:
            stack[-1].kids.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        _close_implied(stack, tag)
        attributes = m[3]
        names = " ".join(v.strip("\"'") for _, v in _NAMES.findall(attributes)).lower() if "=" in attributes else ""
        node = Node(tag, names, bool(attributes) and bool(_HIDDEN.search(attributes)))
        stack[-1].kids.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.append(node)
    return root


def _close_implied(stack: list[Node], tag: str) -> None:
    ends = SIBLINGS.get(tag, ())
    for depth in range(len(stack) - 1, 0, -1):
        open_tag = stack[depth].tag
        if open_tag in ends or (open_tag == "p" and tag in CLOSED_BY_BLOCK):
            del stack[depth:]
            return
        if open_tag in SCOPES:
            return


# Words that also name content: inside an article or main element they say nothing.
BROAD_NAMES = frozenset("header masthead notice notices alert search".split())


def part_words(node: Node) -> set[str]:
    """The words by which an element names itself a part; "has-sidebar" and the like tell of the layout instead."""
    out: set[str] = set()
    for name in node.names.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if words and words[0] not in ("has", "no", "with", "without", "is"):
            out.update(w for w in words if w in PART_NAMES)
    return out


def is_boilerplate(node: Node, inside: bool, held: frozenset = frozenset()) -> bool:
    """Whether the element says of itself that it is no content. inside: within an article or main element.

    held: ids of elements whose names are not asked, see holders().
    """
    if node.tag in NOT_CONTENT or node.hidden or (node.tag == "header" and not inside):
        return True
    if not node.names or node.tag in ("html", "body", "article", "main") or id(node) in held:
        return False
    words = part_words(node)
    return bool(words - BROAD_NAMES if inside else words)


def holders(root: Node, dropped: frozenset = frozenset()) -> frozenset:
    """Ids of the elements that name themselves a part but hold more text than all the slots outside them.

    Slots: what remains without the parts and without the dropped template texts.
    """
    # sizes of the text of each element: all that could be read, and what is read without named parts
    order, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        order.append((node, inside))
        todo += [(k, inside or k.tag in ("article", "main")) for k in node.elements() if not _silent(k, inside)]
    could: dict[int, int] = {}
    read: dict[int, int] = {}
    named = []
    for node, inside in reversed(order):
        own = 0 if id(node) in dropped else sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        kids = [id(k) for k in node.elements()]
        could[id(node)] = own + sum(could.get(k, 0) for k in kids)
        part = is_boilerplate(node, inside)
        read[id(node)] = 0 if part else own + sum(read.get(k, 0) for k in kids)
        if part:
            named.append(node)
    outside = read[id(root)]
    # what reads as content inside the element once its name is not asked
    inner = {id(n): sum(read.get(id(k), 0) for k in n.elements()) + (0 if id(n) in dropped else sum(len(k.strip()) for k in n.kids if isinstance(k, str)))
             for n in named}
    # comments of readers are no content however long they are
    return frozenset(id(n) for n in named if inner[id(n)] > outside and not part_words(n) & READERS)


READERS = frozenset("comment comments commentlist disqus replies respond".split())


def _silent(node: Node, inside: bool) -> bool:
    """Whether the kind of the element alone says that it is no content."""
    return node.tag in NOT_CONTENT or node.hidden or (node.tag == "header" and not inside)


def content_roots(root: Node, held: frozenset = frozenset()) -> list[Node]:
    """The main elements and the top-level articles outside them in page order, or the page if there are none."""
    found: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "article" and not part_words(node) or node is not root and is_main(node) and not is_boilerplate(node, False, held):
            found.append(node)
        elif node is root or not is_boilerplate(node, False, held) and node.tag != "article":
            todo += reversed(node.elements())
    return found or [root]


def is_main(node: Node) -> bool:
    return node.tag == "main" or bool(re.search(r"(?<![\w-])main(?![\w-])", node.names))


def text_of(node: Node, inside: bool, dropped: frozenset, held: frozenset = frozenset()) -> str:
    out: list[str] = []
    todo: list[tuple[Node | str, bool]] = [(node, inside)]
    while todo:
        n, within = todo.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        parts: list[tuple[Node | str, bool]] = []
        for kid in n.kids:
            if isinstance(kid, str):
                if id(n) not in dropped:
                    parts.append((kid, within))
            elif not is_boilerplate(kid, within, held) and not (kid.tag == "article" and part_words(kid)):
                own = (kid, within or kid.tag == "article")
                parts += [own] if kid.tag in INLINE else [(" ", within), own, (" ", within)]
        todo += reversed(parts)
    return " ".join("".join(out).split())


def preorder(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += reversed(node.elements())
    return out


def _shapes(root: Node, known: dict) -> dict[int, int]:
    """A number for the tags below each element; equal trees of tags have equal numbers."""
    out: dict[int, int] = {}
    for node in reversed(preorder(root)):
        out[id(node)] = known.setdefault((node.tag, *[out[id(k)] for k in node.elements()]), len(known))
    return out


def matched(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the size of the largest alignment of two trees, and its pairs."""
    known: dict = {}
    shapes = _shapes(a, known) | _shapes(b, known)
    # the open calls stand in a list, so that pages may be nested to any depth
    calls, result = [_match(a, b, shapes)], None
    while calls:
        try:
            asked = calls[-1].send(result)
            calls.append(_match(*asked, shapes))
            result = None
        except StopIteration as done:
            calls.pop()
            result = done.value
    return result


def _match(a: Node, b: Node, shapes: dict[int, int]):
    """Asks for the matching of pairs of kids and returns that of two elements."""
    if a.tag != b.tag:
        return 0, []
    if shapes[id(a)] == shapes[id(b)]:
        same = list(zip(preorder(a), preorder(b)))
        return len(same), same
    left, right = a.elements(), b.elements()
    out = [(a, b)]
    # kids of equal shape at the end and at the start are a best match already
    for end in (-1, 0):
        at = 0
        while at < min(len(left), len(right)):
            x, y = (left[-1 - at], right[-1 - at]) if end else (left[at], right[at])
            if shapes[id(x)] != shapes[id(y)]:
                break
            out += zip(preorder(x), preorder(y))
            at += 1
        left, right = (left[: len(left) - at], right[: len(right) - at]) if end else (left[at:], right[at:])
    if not left or not right:
        return len(out), out
    best = [[(0, None)] * (len(right) + 1) for _ in range(len(left) + 1)]
    pairs = {}
    for i, x in enumerate(left, 1):
        for j, y in enumerate(right, 1):
            up, back = best[i - 1][j][0], best[i][j - 1][0]
            size = 0
            if x.tag == y.tag:
                size, pairs[i, j] = yield x, y
            both = best[i - 1][j - 1][0] + size
            if size and both >= up and both >= back:
                best[i][j] = (both, "both")
            else:
                best[i][j] = (up, "up") if up >= back else (back, "back")
    i, j = len(left), len(right)
    while i and j:
        step = best[i][j][1]
        if step == "both":
            out += pairs[i, j]
            i, j = i - 1, j - 1
        elif step == "up":
            i -= 1
        else:
            j -= 1
    return len(out), out


def _contents(root: Node) -> set[int]:
    """Ids of the elements that the extraction would read."""
    held = holders(root)
    out: set[int] = set()
    todo = [(start, is_slot(start)) for start in content_roots(root, held)]
    while todo:
        node, inside = todo.pop()
        out.add(id(node))
        todo += [(k, inside or k.tag == "article") for k in node.elements() if not is_boilerplate(k, inside, held)]
    return out


def is_slot(node: Node) -> bool:
    return node.tag == "article" or is_main(node)


def tag_paths(root: Node) -> frozenset[int]:
    """Hashes of the different paths of block elements of a tree: its layout, however many elements share a path."""
    import xxhash

    out, todo = set(), [(root, 0)]
    while todo:
        node, path = todo.pop()
        for kid in node.elements():
            if kid.tag not in INLINE and kid.tag not in VOID and kid.tag not in RAW:
                own = xxhash.xxh3_64_intdigest(f"{path}/{kid.tag}".encode("utf-8", "surrogatepass"))
                out.add(own)
                todo.append((kid, own))
    return frozenset(out)


def alike(a: frozenset, b: frozenset) -> float:
    return len(a & b) / max(1, len(a | b))


#: Likeness of tag paths from which pages have one layout, and multiple of a host's mean elements that makes a freak.
FIT = 0.5
FREAK = 4


def leaders(paths: list[frozenset], fit: float = FIT) -> list[int]:
    """Numbers of the path sets, in their order, that are like none of the leaders before. Empty ones are like nothing."""
    out: list[int] = []
    for n, own in enumerate(paths):
        if own and all(alike(own, paths[i]) < fit for i in out):
            out.append(n)
    return out


class Layouts:
    """The reference trees of a host, one for each layout; elements are numbered in page order."""

    def __init__(self, data: list):
        self.trees, self.paths, self.numbers, self.contents = [], [], [], []
        self.nearest: dict[frozenset, int] = {}
        for flat in data:
            nodes: list[Node] = []
            for tag, parent, _ in flat:
                node = Node(tag)
                if nodes:
                    nodes[parent].kids.append(node)
                nodes.append(node)
            self.trees.append(nodes[0])
            self.paths.append(tag_paths(nodes[0]))
            self.numbers.append({id(n): i for i, n in enumerate(nodes)})
            self.contents.append([bool(content) for _, _, content in flat])

    @staticmethod
    def of(pages: list[str], least: int = 4) -> list | None:
        """The layouts of different pages as plain data; None if there are fewer than least pages."""
        trees = [parse(p) for p in dict.fromkeys(pages)]
        if len(trees) < least:
            return None
        sizes = [len(_contents(t)) for t in trees]
        order = sorted(range(len(trees)), key=lambda i: (sizes[i] * len(sizes) > FREAK * sum(sizes), -sizes[i]))
        paths = [tag_paths(trees[i]) for i in order]
        return [Layouts.flat(trees[order[n]]) for n in leaders(paths)] or None

    @staticmethod
    def flat(tree: Node) -> list:
        """A reference tree as rows (tag, number of the parent, whether the extraction would read it)."""
        contents, out, todo = _contents(tree), [], [(tree, -1)]
        while todo:
            node, parent = todo.pop()
            todo += [(k, len(out)) for k in reversed(node.elements())]
            out.append((node.tag, parent, int(id(node) in contents)))
        return out

    def align(self, root: Node, fit: float = FIT) -> tuple[int, list[tuple[int, Node]]] | None:
        """The layout of a page, and the numbers of the reference elements with the page's elements."""
        paths = tag_paths(root)
        best = self.nearest.get(paths)
        if best is None:
            best = max(range(len(self.trees)), key=lambda i: alike(paths, self.paths[i]))
            if len(self.nearest) > 10_000:
                self.nearest.clear()
            self.nearest[paths] = best
        if alike(paths, self.paths[best]) < fit:
            return None
        number = self.numbers[best]
        return best, [(number[id(a)], b) for a, b in matched(self.trees[best], root)[1]]

    def marks(self, page: str) -> tuple[int, np.ndarray, np.ndarray] | None:
        """The layout, and for each reference element a mark of the page's text there and its length.

        A mark is 0 without an aligned element and 1 for no text. Only elements that would be read have marks, and the root.
        """
        found = self.align(parse(page))
        if found is None:
            return None
        layout, pairs = found
        contents = self.contents[layout]
        marks, sizes = np.zeros(len(contents), np.uint64), np.zeros(len(contents), np.int64)
        for n, node in pairs:
            if contents[n]:
                text = node.own_text()
                marks[n], sizes[n] = text_mark(text), len(text)
        marks[0] = max(int(marks[0]), 1)
        return layout, marks, sizes


def text_mark(text: str) -> int:
    import xxhash

    return max(2, xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))) if text else 1


def _tally(marks: np.ndarray, sizes: np.ndarray, given: np.ndarray | None, tally: dict) -> None:
    """Adds a page to {(node, mark): [pages, length]}; near copies of the given constants are left out."""
    if given is not None:
        held = marks[: len(given)]
        if sizes[: len(given)][(held == given) & (held > 1)].sum() * 2 > sizes.sum():
            return
    for n in np.flatnonzero(marks).tolist():
        own = tally.setdefault((n, int(marks[n])), [0, int(sizes[n])])
        own[0] += 1


def constants(nodes: list[tuple], least: int, share: float = 0.8, most_constant: float = 0.3) -> tuple[dict[int, int], bool]:
    """{node: mark} of the constant nodes of a layout, and whether they hold more of the content than they may.

    nodes: (node, pages aligned, pages with the most frequent mark, that mark, its length, characters of all pages).
    """
    found = {n: (mark, size) for n, aligned, same, mark, size, _ in nodes if mark > 1 and aligned >= least and same >= share * aligned}
    pages = max((aligned for n, aligned, *_ in nodes if n == 0), default=0)
    over = sum(size for _, size in found.values()) * pages > most_constant * max(1, sum(chars for *_, chars in nodes))
    return {n: mark for n, (mark, _) in found.items()}, over


def _most_frequent(tally: dict) -> list[tuple]:
    """What constants() takes, from the tally of one layout."""
    by_node: dict[int, list[tuple[int, int, int]]] = {}
    for (n, mark), (count, size) in tally.items():
        by_node.setdefault(n, []).append((count, mark, size))
    return [(n, sum(c for c, _, _ in own), *max(own), sum(c * size for c, _, size in own)) for n, own in sorted(by_node.items())]


def induce(pages: list[str], least: int = 4) -> str | None:
    """The wrapper of a host's pages as JSON, or None where no content node is constant; all of them in one process."""
    different = list(dict.fromkeys(pages))
    data = Layouts.of(different, least)
    if data is None:
        return None
    layouts = Layouts(data)
    marked = [m for m in map(layouts.marks, different) if m is not None]
    fixed = {}
    for layout in range(len(data)):
        tally: dict = {}
        for _, marks, sizes in (m for m in marked if m[0] == layout):
            _tally(marks, sizes, None, tally)
        fixed[layout], over = constants(_most_frequent(tally), least)
        if over:
            given, tally = _given(fixed[layout], len(data[layout])), {}
            for _, marks, sizes in (m for m in marked if m[0] == layout):
                _tally(marks, sizes, given, tally)
            fixed[layout], _ = constants(_most_frequent(tally), least - 1)
    return _wrapper(data, fixed)


def _given(fixed: dict[int, int], size: int) -> np.ndarray:
    out = np.zeros(size, np.uint64)
    for n, mark in fixed.items():
        out[n] = mark
    return out


def _wrapper(data: list, fixed: dict[int, dict[int, int]]) -> str | None:
    return json.dumps([data, [sorted(fixed.get(i, {}).items()) for i in range(len(data))]]) if any(fixed.values()) else None


class Wrapper:
    """The layouts of a host with the marks of their constant nodes."""

    def __init__(self, text: str):
        data, fixed = json.loads(text)
        self.layouts, self.fixed = Layouts(data), [dict(f) for f in fixed]

    def dropped(self, root: Node) -> frozenset:
        """Ids of the elements whose own text is the template's."""
        found = self.layouts.align(root)
        if found is None:
            return frozenset()
        fixed = self.fixed[found[0]]
        return frozenset(id(node) for n, node in found[1] if n in fixed and text_mark(node.own_text()) == fixed[n])


def extract(page: str | None, wrapper: Wrapper | None = None) -> str:
    """The main text of a page, without what matches the constant nodes of the wrapper."""
    if not page:
        return ""
    root = parse(page)
    dropped = wrapper.dropped(root) if wrapper is not None else frozenset()
    held = holders(root, dropped)
    texts = (text_of(start, is_slot(start), dropped, held) for start in content_roots(root, held))
    return " ".join(t for t in texts if t)


#: Bytes of layouts or wrappers up to which they are sent to every task; more are joined by host.
MOST_SENT = 64 << 20


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", least: int = 4) -> DataFrame:
    """Rows (host, wrapper) of the hosts that have one. All different pages of a host name its layouts, and the
    constant texts are counted over all of them."""
    keyed = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).where("html IS NOT NULL")
    keyed = keyed.withColumn("key", F.xxhash64("html"))
    chosen = reference_pages(keyed, least)
    taken = keyed.join(light(chosen), ["host", "key"]).dropDuplicates(["host", "key"]).select("host", "rank", "key", "html")

    def lay_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, "host"):
            yield pd.DataFrame([(group["host"].iloc[0], json.dumps([Layouts.flat(parse(p)) for p in group["html"]]))], columns=["host", "layouts"])

    parts = taken.repartition("host").sortWithinPartitions("host", "rank", "key")
    layouts = stored(parts.mapInPandas(lay_out, "host string, layouts string"))
    marked = keyed.join(light(layouts, 10_000, MOST_SENT), "host").mapInPandas(
        _mark, "host string, key bigint, layout int, marks binary, sizes binary")
    marked = stored(marked.dropDuplicates(["host", "key"]))
    judged = stored(_judged(marked.withColumn("given", F.lit(None).cast("binary")), least))
    near = stored(judged.where("over").select("host", "layout", F.col("fixed").alias("given")))
    fixed = judged.where("NOT over")
    if not near.isEmpty():
        fixed = fixed.unionByName(_judged(marked.join(light(near, 10_000, MOST_SENT), ["host", "layout"]), least - 1))
    fixed = fixed.groupBy("host").agg(F.collect_list(F.struct("layout", "fixed")).alias("fixed"))

    def wrap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for host, data, given in zip(batch["host"], batch["layouts"], batch["fixed"]):
                own = {g["layout"]: np.frombuffer(g["fixed"], np.uint64) for g in given}
                wrapper = _wrapper(json.loads(data), {k: {int(n): int(v[n]) for n in np.flatnonzero(v)} for k, v in own.items()})
                if wrapper is not None:
                    out.append((host, wrapper))
            if out:
                yield pd.DataFrame(out, columns=["host", "wrapper"])

    return stored(layouts.join(fixed, "host").mapInPandas(wrap, "host string, wrapper string"))


def reference_pages(keyed: DataFrame, least: int, most: int = 1000) -> DataFrame:
    """Rows (host, rank, key): the reference pages of the layouts of each host of at least so many different pages.

    keyed: rows (host, html, key). Every page is like a reference, but for pages without block elements. References
    are found among the different sets of tag paths of a host: the first so many of them in one task, then the sets that
    are like none found are taken up again, until there are none.
    """
    kinds = "host string, key bigint, paths binary, size int"
    different = stored(keyed.mapInPandas(_outline, kinds).dropDuplicates(["host", "key"]))
    hosts = different.groupBy("host").agg(F.count("*").alias("pages"), F.sum("size").alias("sizes")).where(F.col("pages") >= least)
    freak = (F.col("size") * F.col("pages") > FREAK * F.col("sizes")).cast("bigint")
    # the sets are ranked by their first page: no freaks, many elements
    ranked = different.where(F.length("paths") > 0).join(light(stored(hosts)), "host").withColumn("rank", freak * (1 << 32) - F.col("size"))
    left = stored(ranked.groupBy("host", "paths").agg(F.min(F.struct("rank", "key")).alias("first")).select("host", "paths", "first.*"))
    order = Window.partitionBy("host").orderBy("rank", "key", "paths")
    found = None
    while not left.isEmpty():
        tried = left.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")
        new = stored(tried.repartition("host").sortWithinPartitions("host", "rank", "key", "paths").mapInPandas(_lead, tried.schema))
        own = new.groupBy("host").agg(F.collect_list("paths").alias("leaders"))
        left = stored(left.join(own, "host").mapInPandas(_unlike, left.schema))
        found = new if found is None else found.unionByName(new)
    return (left if found is None else found).select("host", "rank", "key")


def _outline(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        trees = map(parse, batch["html"])
        outlines = [(np.array(sorted(tag_paths(t)), np.uint64).tobytes(), len(_contents(t))) for t in trees]
        yield pd.DataFrame({"host": batch["host"], "key": batch["key"], "paths": [p for p, _ in outlines], "size": [n for _, n in outlines]})


def _path_set(data: bytes) -> frozenset[int]:
    return frozenset(np.frombuffer(data, np.uint64).tolist())


def _lead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for group in runs(batches, "host"):
        yield group.iloc[leaders([_path_set(p) for p in group["paths"]])]


def _unlike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        known: dict[str, list[frozenset]] = {}
        keep = []
        for host, paths, found in zip(batch["host"], batch["paths"], batch["leaders"]):
            if host not in known:
                known[host] = [_path_set(p) for p in found]
            own = _path_set(paths)
            keep.append(all(alike(own, other) < FIT for other in known[host]))
        yield batch.loc[keep, ["host", "paths", "rank", "key"]]


def _mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, Layouts] = {}
    for batch in batches:
        out = []
        for host, key, page, data in zip(batch["host"], batch["key"], batch["html"], batch["layouts"]):
            if host not in known:
                if len(known) > 1000:
                    known.clear()
                known[host] = Layouts(json.loads(data))
            found = known[host].marks(page)
            if found is not None:
                out.append((host, key, found[0], found[1].tobytes(), found[2].tobytes()))
        if out:
            yield pd.DataFrame(out, columns=["host", "key", "layout", "marks", "sizes"])


def _judged(marked: DataFrame, least: int) -> DataFrame:
    """Rows (host, layout, fixed, over): the marks of the constant nodes, counted in the tasks and then by node."""

    def count(batches: Iterator[pd.DataFrame], most: int = 200_000) -> Iterator[pd.DataFrame]:
        tallies: dict[tuple[str, int], dict] = {}

        def flush() -> pd.DataFrame:
            rows = [(*k, n, mark - (1 << 63), c, size) for k, t in tallies.items() for (n, mark), (c, size) in t.items()]
            return pd.DataFrame(rows, columns=["host", "layout", "node", "mark", "n", "size"])

        for batch in batches:
            for host, layout, marks, sizes, given in zip(*(batch[c] for c in ("host", "layout", "marks", "sizes", "given"))):
                given = None if given is None else np.frombuffer(given, np.uint64)
                _tally(np.frombuffer(marks, np.uint64), np.frombuffer(sizes, np.int64), given, tallies.setdefault((host, layout), {}))
            if sum(map(len, tallies.values())) > most:
                yield flush()
                tallies.clear()
        if tallies:
            yield flush()

    counted = marked.mapInPandas(count, "host string, layout int, node int, mark bigint, n bigint, size bigint")
    counted = counted.groupBy("host", "layout", "node", "mark").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    nodes = counted.groupBy("host", "layout", "node").agg(
        F.sum("n").alias("aligned"), F.max(F.struct("n", "mark", "size")).alias("top"), F.sum(F.col("n") * F.col("size")).alias("chars"))
    nodes = nodes.select("host", "layout", "node", "aligned", "top.n", "top.mark", "top.size", "chars")
    nodes = nodes.withColumn("of", F.concat_ws(" ", F.col("layout").cast("string"), "host"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, "of"):
            rows = [(n, aligned, same, mark + (1 << 63), size, chars) for n, aligned, same, mark, size, chars in zip(
                *(group[c].tolist() for c in ("node", "aligned", "n", "mark", "size", "chars")))]
            fixed, over = constants(rows, least)
            # nodes behind the last one that any page has are not written
            data = _given(fixed, rows[-1][0] + 1).tobytes()
            yield pd.DataFrame([(group["host"].iloc[0], group["layout"].iloc[0], data, over)], columns=["host", "layout", "fixed", "over"])

    parts = nodes.repartition("of").sortWithinPartitions("of", "node")
    return parts.mapInPandas(judge, "host string, layout int, fixed binary, over boolean")


def main_text(pages: DataFrame, name: str = "main_text", url_col: str = "url", html_col: str = "html", **more) -> DataFrame:
    """The pages with their main text."""
    learned = wrappers(pages, url_col=url_col, html_col=html_col, **more)
    key, column = unused(pages, "host"), unused(pages, "wrapper")
    if learned.isEmpty():
        wrapped = pages.withColumn(column, F.lit(None).cast("string"))
    else:
        learned = light(learned, 10_000, MOST_SENT).select(F.col("host").alias(key), F.col("wrapper").alias(column))
        wrapped = pages.withColumn(key, host_of(F.col(url_col))).join(learned, key, "left").drop(key)
    read = F.pandas_udf(_reader(), "string")
    return wrapped.withColumn(name, read(F.col(html_col), F.col(column))).drop(column)


def _reader():
    def read(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, Wrapper] = {}
        for pages, given in parts:
            out = []
            for page, wrapper in zip(pages, given):
                if isinstance(wrapper, str) and wrapper not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[wrapper] = Wrapper(wrapper)
                out.append(extract(page if isinstance(page, str) else None, known[wrapper] if isinstance(wrapper, str) else None))
            yield pd.Series(out, dtype=object)

    return read
