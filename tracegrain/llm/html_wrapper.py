"""Operator 2: main text of web pages by wrappers, union-free regular expressions.

For every host a wrapper is inferred from all its pages.  A page's token stream is
nested by its block elements; runs of text and inline elements between them are
text slots.  Adjacent equal structures are folded into repeated groups, and two
wrappers are aligned level by level: what only one of them has becomes optional,
runs of different length become repeated, and different texts leave a slot where
equal ones leave a constant of the template.

The wrapper then decides.  The region of the article is the article or main
elements if the template has some, else the deepest part that holds most of the
text in slots; constants of the template, however long, don't count.  Of the rest,
elements that HTML itself sets apart (nav, aside, footer, form, script and so on,
hidden ones, and those whose whole class or id says what they are) go.  A class
that merely has such a word in it, as in social-history, is a hint: its element
goes only if the wrapper agrees, because it is a constant of the template, is
mostly links, or is a repeated group.  Constants inside an article element stay; in
another region those go that all pages have in an element with a class or id of its
own.  Pages are read through their host's labels; a page that lacks the host's region is labelled
by itself.

Wrappers don't depend on how pages are dealt to tasks: pages of equal structure
are summed up first, whatever their order, and different structures are merged in
the order of their hashes, some ``FAN`` at a time, level by level.

Scale: html isn't shuffled; a task gives a row for each structure of a host among
its pages.  No merge has more than some ``FAN`` structures, so a host with a third
of all pages is no single task.  Alignment of long lists is linear but for the gaps
between elements that occur once.  Labels are broadcast if they take at most
``BROADCAST_BYTES``, else joined by host.

Edge cases: null and empty html give the empty text; a null url is a host of its
own; html without tags is one block; unclosed and stray tags are read as browsers
do in the common cases; elements nested below DEEPEST levels count as children of
the last such level, and no text is lost; of parts that tie, the first path in
order is the region; repeated rows give repeated rows; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import html as html_lib
import json
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

BROADCAST_BYTES = 16_000_000
FAN, DEEPEST = 64, 150
#: Two lists with so many pairs of elements are aligned by dynamic programming, longer ones by elements that occur once.
PAIRS = 10_000
#: Structures that a task keeps before it gives its rows.
KEPT = 2000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg object canvas math audio video textarea title xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("br body html head td th tr tbody thead tfoot caption option legend".split())
SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
DROP_TAGS = frozenset("head nav footer aside form button select dialog menu input label".split()) | RAW
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote figure figcaption caption tr thead tbody tfoot summary details".split())
PLAIN = frozenset("html head body article main".split())
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe subscription signup sidebar widget widgets menu nav navbar navigation "
    "breadcrumb breadcrumbs header masthead footer comment comments commentlist disqus reply replies respond discussion share sharing social "
    "related recommended recommendations pagination pager copyright legal disclaimer login search toolbar skip".split()
)
NOISE_ARTICLE = frozenset("comment comments reply ad advert sponsored promo related recommended teaser".split())
#: Names that parts of an article have too.
HEADS = frozenset("header masthead notice notices".split())
NOISE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")


SURE, HINT = 2, 1


class Node:
    """An element (or the root), a text slot ('#') or a repeated group ('()').

    noise: SURE, HINT or 0.  Of a slot: characters, those of links, the digest of
    its text while it has one only, and pages that have it.
    """

    __slots__ = ("block", "chars", "children", "constant", "links", "noise", "opt", "pages", "rep", "sig", "text")

    def __init__(self, sig: str, noise: int = 0, text: str = ""):
        self.sig, self.noise, self.text = sig, noise, text
        self.children: list[Node] = []
        self.rep = self.opt = self.block = False
        self.constant: str | None = None
        self.chars = self.links = 0
        self.pages = 1

    def structure(self) -> list:
        return [self.sig, self.noise + self.rep * 4 + self.opt * 8, *(c.structure() for c in self.children)]

    def slots(self) -> list[Node]:
        return [self] if self.sig == "#" else [x for c in self.children for x in c.slots()]

    @staticmethod
    def load(x: list) -> Node:
        n = Node(x[0], x[1] & 3)
        n.rep, n.opt = bool(x[1] & 4), bool(x[1] & 8)
        n.children = [Node.load(c) for c in x[2:]]
        return n


def _noise(name: str, given: dict[str, str]) -> int:
    if name in ("html", "body", "main"):
        return 0
    if name in DROP_TAGS and name != "header":
        return SURE
    hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true"
    if hidden or re.search(r"display\s*:\s*none", given.get("style", ""), re.I) or given.get("role", "").lower() in NOISE_ROLE:
        return SURE
    words = NOISE_ARTICLE if name == "article" else NOISE
    out = SURE if name == "header" else 0
    for value in " ".join(given.get(k, "") for k in ("class", "id")).split():
        own = {t.lower() for t in _NAME.findall(value)}
        if own and own <= words and not own <= HEADS:
            return SURE
        if own & words:
            out = max(out, HINT)
    return out


def _element(name: str, attributes: str) -> Node:
    given = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(attributes)} if attributes else {}
    noise = _noise(name, given)
    if not given or name in PLAIN and not noise:
        return Node(name, noise)
    kept = ".".join(sorted(re.sub(r"\d+", "0", given.get("class", "")).split()))
    return Node(f"{name}.{kept}#{re.sub(r'\d+', '0', given.get('id', ''))}" + (":" + given["role"] if "role" in given else ""), noise)


def tag_of(sig: str) -> str:
    return re.split(r"[.#:]", sig, maxsplit=1)[0]


def parse(page: str) -> Node:
    """The nested token stream; text nodes hold raw text."""
    root = Node("root")
    stack: list[tuple[str, Node]] = [("root", root)]
    at, n = 0, len(page)
    text: list[str] = []

    def put() -> None:
        if text:
            run = "".join(text)
            text.clear()
            if run.strip():
                stack[-1][1].children.append(Node("#", text=run))
            elif stack[-1][1].children and stack[-1][1].children[-1].sig not in BLOCK:
                stack[-1][1].children.append(Node("#", text=" "))

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text.append(page[at:])
            break
        text.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if m is None:
            if lt + 1 < n and (page[lt + 1].isalpha() or page[lt + 1] == "/"):
                break  # a tag that the page's end cuts off
            text.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    put()
                    del stack[i:]
                    break
            continue
        put()
        if name in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK:
                    break
        if name in SAME:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in SAME[name]:
                    break
                if stack[i][0] == name or (name, stack[i][0]) in (("dt", "dd"), ("dd", "dt"), ("td", "th"), ("th", "td")):
                    del stack[i:]
                    break
        node = _element(name, m[3])
        stack[-1][1].children.append(node)
        if name in VOID or (m[3].endswith("/") and name not in BLOCK):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = n if end is None else end.end()
            continue
        if len(stack) < DEEPEST:
            stack.append((name, node))
    put()
    _mark(root)
    return root


def _mark(node: Node) -> bool:
    """Set block: whether an element is one of the structure, being a block or holding one."""
    inside = False
    for c in node.children:
        if c.sig != "#":
            inside |= _mark(c)
    node.block = inside or tag_of(node.sig) in BLOCK
    return node.block


def _clean(raw: str) -> str:
    return " ".join(html_lib.unescape(raw).split())


# ---- wrappers


def _key(nodes: list[Node]) -> tuple[str, ...]:
    return tuple(n.sig for n in nodes)


def fold(children: list[Node]) -> list[Node]:
    """Adjacent equal structures as repeated nodes and groups of up to four."""
    for width in (1, 2, 3, 4):
        out: list[Node] = []
        i = 0
        while i < len(children):
            run = children[i : i + width]
            j = i + width
            while len(run) == width and j + width <= len(children) and _key(children[j : j + width]) == _key(run):
                run = [merge(a, b, False) for a, b in zip(run, children[j : j + width], strict=True)]
                j += width
            if j == i + width or len(run) < width:
                out.append(children[i])
                i += 1
                continue
            if width == 1:
                run[0].rep = True
                out += run
            else:
                group = Node("(" + "|".join(_key(run)) + ")")
                group.rep, group.children = True, run
                out.append(group)
            i = j
        children = out
    return children


def wrapper(node: Node) -> Node:
    """The wrapper of one page: its blocks, and slots for what stands between them."""
    out = Node(node.sig, node.noise)
    found: list[Node] = []
    run: list[tuple[str, bool]] = []

    def put() -> None:
        text = _clean("".join(t for t, _ in run))
        if text:
            slot = Node("#")
            slot.chars, slot.links = len(text), sum(len(_clean(t)) for t, linked in run if linked)
            slot.constant = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
            found.append(slot)
        run.clear()

    def inline(n: Node, linked: bool) -> None:
        for c in n.children:
            if c.sig == "#":
                run.append((c.text, linked))
            elif c.noise != SURE:
                inline(c, linked or tag_of(c.sig) == "a")

    for c in node.children:
        if c.sig == "#":
            run.append((c.text, tag_of(node.sig) == "a"))
        elif c.block:
            put()
            found.append(wrapper(c))
        elif c.noise != SURE:
            inline(c, tag_of(c.sig) == "a")
    put()
    out.children = fold(found)
    return out


def aligned(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of equal elements in both lists, in order: equal ends, then a longest common subsequence.

    Between long lists, of the elements that both have once the longest increasing
    run; gaps between those are aligned in the same way, or not at all without any.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        if (b - a) * (d - c) <= PAIRS:
            best = [[0] * (d - c + 1) for _ in range(b - a + 1)]
            for i in range(b - a - 1, -1, -1):
                for j in range(d - c - 1, -1, -1):
                    best[i][j] = best[i + 1][j + 1] + 1 if x[a + i] == y[c + j] else max(best[i + 1][j], best[i][j + 1])
            i = j = 0
            while i < b - a and j < d - c:
                if x[a + i] == y[c + j]:
                    out.append((a + i, c + j))
                    i, j = i + 1, j + 1
                elif best[i + 1][j] >= best[i][j + 1]:
                    i += 1
                else:
                    j += 1
            continue
        once_x, once_y = Counter(x[a:b]), Counter(y[c:d])
        at = {v: j for j, v in enumerate(y[c:d], c) if once_y[v] == 1}
        common = [(i, at[v]) for i, v in enumerate(x[a:b], a) if once_x[v] == 1 and v in at]
        tops: list[int] = []
        ends: list[int] = []
        before: list[int] = []
        for k, (_, j) in enumerate(common):
            p = bisect.bisect_left(tops, j)
            tops[p : p + 1], ends[p : p + 1] = [j], [k]
            before.append(ends[p - 1] if p else -1)
        k, anchors = (ends[-1] if ends else -1), []
        while k >= 0:
            anchors.append(common[k])
            k = before[k]
        i, j = a, c
        for p, q in reversed(anchors):
            todo.append((i, p, j, q))
            out.append((p, q))
            i, j = p + 1, q + 1
        if anchors:
            todo.append((i, b, j, d))
    return sorted(out)


def merge(a: Node, b: Node, apart: bool = True) -> Node:
    """The wrapper of what either describes; ``apart``: they come of different pages."""
    out = Node(a.sig, min(a.noise, b.noise))
    out.rep, out.opt = a.rep or b.rep, a.opt or b.opt
    out.chars, out.links = a.chars + b.chars, a.links + b.links
    out.pages = a.pages + b.pages if apart else max(a.pages, b.pages)
    if a.sig == "#":
        out.constant = a.constant if a.constant == b.constant else None
        return out
    x, y = a.children, b.children
    pairs = aligned([n.sig for n in x], [n.sig for n in y])
    i = j = 0
    for p, q in [*pairs, (len(x), len(y))]:
        for own in [*x[i:p], *y[j:q]]:
            own.opt = True
            out.children.append(own)
        if p < len(x):
            out.children.append(merge(x[p], y[q], apart))
        i, j = p + 1, q + 1
    if len(pairs) < max(len(x), len(y)):
        out.children = fold(out.children)
    return out


# ---- labels


def label(w: Node, pages: int) -> dict:
    """regions, drops: paths of signatures."""
    drops: set[str] = set()
    hints: dict[str, bool] = {}  # whether all that have the path may go
    dense: set[str] = set()
    fixed_parts: dict[str, bool] = {}  # whether all that have the path are constants of every page
    articles, mains, weak = [], [], []
    repeated: set[str] = set()
    slots: dict[str, int] = {}

    def walk(node: Node, path: str, gone: bool, article: bool) -> tuple[int, int, int]:
        """(characters in slots, in constants, in links) that aren't dropped."""
        if node.sig == "#":
            own = node.constant is not None and pages > 1 and node.pages > 1
            return (0, 0, 0) if gone else (0, node.chars, node.links) if own else (node.chars, 0, node.links)
        group = node.sig.startswith("(")
        here = path if group or node.sig == "root" else f"{path}>{node.sig}"
        tag = tag_of(node.sig)
        if node.rep:
            repeated.update([here] if not group else [f"{path}>{c.sig}" for c in node.children])
        if not group and node.noise == SURE and not (tag == "header" and article):
            drops.add(here)
            gone = True
        if tag in ("article", "main") and not article:
            (weak if gone and here not in drops else articles if tag == "article" else mains).append((here, gone))
        varied = fixed = links = 0
        for c in node.children:
            v, f, n = walk(c, here, gone, article or tag in ("article", "main"))
            varied, fixed, links = varied + v, fixed + f, links + n
        if not group and not gone:
            every = varied + fixed
            if node.noise == HINT and every:
                agrees = not varied and pages > 1 or 2 * links >= every or node.rep and not article
                hints[here] = hints.get(here, True) and agrees
                varied = 0 if agrees else varied
            if not article and (node.sig != tag or here in fixed_parts):
                fixed_parts[here] = fixed_parts.get(here, True) and not varied and not node.opt and pages > 1
            if tag in ("ul", "ol", "table", "div", "section") and every and links * 5 >= every * 4:
                dense.add(here)
                varied = 0
            slots[here] = slots.get(here, 0) + varied
        return varied, fixed, links

    def nested(node: Node, path: str, found: list[str]) -> None:
        for c in node.children:
            if c.sig == "#":
                continue
            here = path if c.sig.startswith("(") else f"{path}>{c.sig}"
            if tag_of(c.sig) == "article" and c.noise != SURE:
                found.append(here)
            elif c.noise != SURE:
                nested(c, here, found)

    varied, fixed, _ = walk(w, "", False, False)
    drops |= {p for p, agrees in hints.items() if agrees}
    regions = [p for p, gone in articles if not gone]
    in_main = []
    for p, gone in mains:
        if not gone:
            inner: list[str] = []
            _at(w, p, lambda node, p=p, inner=inner: nested(node, p, inner))
            in_main += inner or [p]
    regions += in_main
    if not regions:
        regions = [p for p, _ in weak]
        if regions:  # an article inside a dropped part: the drop was an element left open
            drops = {d for d in drops if not any(r == d or r.startswith(d + ">") for r in regions)}
    if not regions:
        # the deepest part with most of what varies; where nothing does, with most of what there is
        total = varied
        if total:
            drops |= {p for p, every in fixed_parts.items() if every}
        else:
            slots, total = _all_chars(w), fixed
        drops |= dense
        if total:
            # not a paragraph or a member of a repeated group, whose siblings are as much of the article
            parts = [p for p, n in slots.items() if n * 10 >= total * 7 and p not in repeated and tag_of(p.rpartition(">")[2]) not in LEAVES]
            regions = [max(sorted(parts), key=lambda p: p.count(">"), default="")]
    return {"regions": sorted(set(regions)), "drops": sorted(drops - set(regions))}


def _all_chars(w: Node) -> dict[str, int]:
    """Characters by path, whatever they are, outside elements that surely go."""
    out: dict[str, int] = {}

    def walk(node: Node, path: str) -> int:
        if node.sig == "#":
            return node.chars
        group = node.sig.startswith("(")
        here = path if group or node.sig == "root" else f"{path}>{node.sig}"
        n = 0 if node.noise == SURE else sum(walk(c, here) for c in node.children)
        if not group:
            out[here] = out.get(here, 0) + n
        return n

    walk(w, "")
    return out


def _at(node: Node, path: str, do, here: str = "") -> None:
    for c in node.children:
        if c.sig == "#":
            continue
        p = here if c.sig.startswith("(") else f"{here}>{c.sig}"
        if p == path and not c.sig.startswith("("):
            do(c)
        elif path.startswith(p + ">") or p == here:
            _at(c, path, do, p)


def text_of(page: Node, labels: dict) -> str | None:
    """The blocks of the regions; None if the page has none of them."""
    regions, drops = labels["regions"], labels["drops"]
    blocks: list[str] = []
    run: list[str] = []
    found = False

    def flush() -> None:
        text = _clean("".join(run))
        run.clear()
        if text:
            blocks.append(text)

    def walk(node: Node, path: str, on: bool) -> None:
        nonlocal found
        for c in node.children:
            if c.sig == "#":
                if on:
                    run.append(c.text)
                continue
            breaks = tag_of(c.sig) in BLOCK
            if not c.block:
                if c.noise == SURE:
                    continue
                walk(c, path, on)
                continue
            here = f"{path}>{c.sig}"
            if here in drops:
                if on and breaks:
                    flush()
                if not any(r.startswith(here + ">") for r in regions):
                    continue
            now = on and here not in drops or here in regions
            found |= now
            if now and (breaks or not on):
                flush()
            walk(c, here, now)
            if now and (breaks or not on):
                flush()

    found = "" in regions
    walk(page, "", found)
    flush()
    return "\n".join(blocks) if found else None


def extract(page: str | None, labels: dict | None) -> str:
    if not page:
        return ""
    tree = parse(page)
    text = text_of(tree, labels) if labels else None
    if text is None:
        text = text_of(tree, _sets(label(wrapper(tree), 1)))
    return text or ""


def _sets(labels: dict) -> dict:
    return {k: set(v) for k, v in labels.items()}


# ---- distributed


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)), F.lit("\u0000"))


_STRUCTURES = "host string, name string, structure string, pages long, chars array<long>, links array<long>, constants array<string>, counts array<long>"


def _sum_up(old: list | None, pages: int, chars, links, constants, counts) -> list:
    """[pages, chars, links, constants, pages of each slot] of one structure, summed in any order."""
    if old is None:
        return [pages, np.array(chars, np.int64), np.array(links, np.int64), list(constants), np.array(counts, np.int64)]
    old[0] += pages
    old[1] += chars
    old[2] += links
    old[3] = [p if p == q else None for p, q in zip(old[3], constants, strict=True)]
    old[4] += counts
    return old


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _STRUCTURES.split(", ")])


def _row(host: str, structure: str, sums: list) -> tuple:
    return host, hashlib.blake2b(structure.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest(), structure, *sums


def _infer(batches):
    """(host, html) to the structures of a task's pages."""
    found: dict[tuple[str, str], list] = {}
    for pdf in batches:
        for host, page in zip(pdf["host"], pdf["html"], strict=True):
            if page:
                w = wrapper(parse(page))
                slots = w.slots()
                key = host, json.dumps(w.structure(), separators=(",", ":"))
                found[key] = _sum_up(
                    found.get(key), 1, [x.chars for x in slots], [x.links for x in slots], [x.constant for x in slots], [1] * len(slots)
                )
                if len(found) >= KEPT:
                    yield _frame([_row(*k, v) for k, v in found.items()])
                    found = {}
    yield _frame([_row(*k, v) for k, v in found.items()])


def _equal(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of one structure as one."""
    sums = None
    for r in pdf.itertuples(index=False):
        sums = _sum_up(sums, r.pages, r.chars, r.links, r.constants, r.counts)
    return _frame([_row(pdf["host"].iloc[0], pdf["structure"].iloc[0], sums)])


def _loaded(structure: str, chars, links, constants, counts) -> Node:
    w = Node.load(json.loads(structure))
    for x, c, n, k, p in zip(w.slots(), chars, links, constants, counts, strict=True):
        x.chars, x.links, x.constant, x.pages = int(c), int(n), k, int(p)
    return w


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """The wrappers of one host and bucket as one, in the order of their names."""
    out, pages = None, 0
    for r in pdf.sort_values("name").itertuples(index=False):
        own = _loaded(r.structure, r.chars, r.links, r.constants, r.counts)
        out = own if out is None else merge(out, own)
        pages += int(r.pages)
    slots = out.slots()
    sums = [pages, [x.chars for x in slots], [x.links for x in slots], [x.constant for x in slots], [x.pages for x in slots]]
    return _frame([_row(pdf["host"].iloc[0], json.dumps(out.structure(), separators=(",", ":")), sums)])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, structure, pages and what its slots hold), a row for each host."""
    own = small_batches(pages).select(host_of(F.col("url")).alias("host"), "html").mapInPandas(_infer, _STRUCTURES)
    out = cut(own.groupBy("host", "name").applyInPandas(_equal, _STRUCTURES))
    while True:
        n = out.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        if out.isEmpty() or n.agg(F.max("n")).first()[0] == 1:
            return out
        # FAN on average go into one bucket; a host with few has one
        buckets = out.join(cut(n), "host").withColumn("bucket", F.pmod(F.xxhash64("name"), F.ceil(F.col("n") / FAN))).drop("n")
        out = cut(buckets.groupBy("host", "bucket").applyInPandas(lambda pdf: _merged(pdf.drop(columns="bucket")), _STRUCTURES))


def _labels(batches):
    for pdf in batches:
        yield pd.DataFrame({
            "host": pdf["host"],
            "labels": [
                json.dumps(label(_loaded(r.structure, r.chars, r.links, r.constants, r.counts), int(r.pages))) for r in pdf.itertuples(index=False)
            ],
        })


def _extract(shared):
    """(page_id, url, host, html[, labels]) to the texts."""

    def f(batches):
        memo: dict[str, dict | None] = {}
        for pdf in batches:
            texts = []
            own = pdf["labels"] if "labels" in pdf else None
            for i, (host, page) in enumerate(zip(pdf["host"], pdf["html"], strict=True)):
                if host not in memo:
                    if len(memo) > 10_000:
                        memo.clear()
                    raw = shared.value.get(host) if shared else own.iloc[i]
                    memo[host] = _sets(json.loads(raw)) if raw else None
                texts.append(extract(page, memo[host]))
            out = pdf[["page_id", "url"]].astype({"page_id": "Int64"})
            yield out.assign(text=texts, n_chars=[len(t) for t in texts])

    return f


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    labels = cut(wrappers(pages).mapInPandas(_labels, "host string, labels string"))
    size = labels.agg(F.sum(F.octet_length("labels") + F.octet_length("host"))).first()[0] or 0
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    shared = None
    if size <= BROADCAST_BYTES:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: r["labels"] for r in labels.collect()})
    else:
        rows = rows.join(labels, "host", "left")
    return rows.mapInPandas(_extract(shared), "page_id long, url string, text string, n_chars long")
