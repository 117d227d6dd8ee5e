"""Main text of web pages by wrapper induction.

Every page is parsed once into a skeleton (its tree of block elements without text, runs of equal siblings as one
node) and its text blocks. The most frequent skeleton of a host is its reference; each page's skeleton is aligned
with it by simple tree matching. Over the distinct pages of the host (by their unmarked blocks), a reference node that
holds the same text on nearly every page is template; nodes of several pages whose text varies are slots. Of every
page, blocks that hold their template node's constant text are dropped, also within an article or main element, and
elements that say that they are something else (menus, footers, forms, adverts, comments). An article or main element is
the main part. Where there is none, the host's slots tell it: it is the deepest reference node that holds most of their
text outside links, over all pages, together with the first heading that varies; what is aligned beside it goes,
whatever its name and however it varies. If nothing of the main part would be left, its constant text stays.

Trees are walked with explicit stacks, at any depth. Nodes can match only if they have the same labels from the root on,
so others leave both trees before the alignment; what is left is aligned exactly, whatever its size: in time with the
product of the two trees' unlike nodes, row by row in bounded memory.

The counts per node are a grouped sum with one row for each text; no host's pages meet in one task. Skeletons and
blocks are written to the shared folder, so each page is parsed once.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registra.llm.common import in_slices, written

#: A node is template if so many of its pages, and so large a share of them, hold the same text there.
PAGES, SHARE = 3, 0.9
#: Share of the slots' text that the main part of a host's pages holds at least.
MAIN = 0.6
#: Sizes of matchings that an alignment keeps; a bound on memory only: others are computed again when they are asked for.
HELD = 16_000_000

# Element names of HTML, by their parsing rules.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES |= {x: {"thead", "tbody", "tfoot", "tr", "td", "th"} for x in ("thead", "tbody", "tfoot")}
SCOPES = frozenset("ul ol dl table select menu".split())
# Elements, roles and words of class names and ids that mark what isn't main text.
BOILERPLATE = frozenset("head nav footer aside form script style noscript template iframe textarea select button dialog svg canvas object menu search title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription"
    " sidebar nav navbar navigation menu breadcrumb breadcrumbs foot footer masthead topbar toolbar comment comments respond reply replies disqus"
    " share sharing social related recommend recommended recommendations readmore pagination pager login signup search widget skiplink skiplinks copyright disclaimer".split()
)
PHRASES = {"side-bar": "sidebar", "top-bar": "topbar", "site-header": "masthead", "page-header": "masthead", "read-more": "readmore", "skip-link": "skiplink", "skip-links": "skiplinks"}
# Parts that a marking name may have beside such words; a name with any other part (related-work, share-price) marks nothing.
NEUTRAL = frozenset(
    "area articles bar block body bottom box button buttons col container content desktop fixed footer form global group header icon icons inner item items js label left line link links list main mobile"
    " info law more navigation outer page panel posts primary right row secondary section site slot small sticky stories tags text the title top unit wrap wrapper".split()
)

# Quantifiers are possessive: no backtracking on long or broken input. A tag with an odd quote ends at the next bracket.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^'\"<>]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^<>]*+)>|[^<]++|<",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Link(str):
    """Text inside a link."""

    __slots__ = ()


class Node:
    __slots__ = ("children", "label", "marked", "sig", "size", "tag")

    def __init__(self, tag: str, label: str, marked: bool):
        self.tag, self.label, self.marked, self.children, self.sig, self.size = tag, label, marked, [], 0, 1


@lru_cache(maxsize=65536)
def marks(name: str) -> bool:
    """Whether a class or id says that its element is not main text: a word of WORDS, and nothing but NEUTRAL parts beside."""
    plain = re.sub(r"[^a-z]+", "-", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()).strip("-")
    for phrase, word in PHRASES.items():
        plain = re.sub(rf"\b{phrase}\b", word, plain)
    parts = plain.split("-")
    return not WORDS.isdisjoint(parts) and all(p in WORDS or p in NEUTRAL for p in parts)


def _element(tag: str, attrs: str) -> Node:
    label, marked = re.sub(r"[(),.!]", "-", tag), tag in BOILERPLATE
    if attrs and "=" in attrs:
        names = []
        for m in ATTRIBUTE.finditer(attrs):
            value = m[2] or m[3] or m[4] or ""
            marked |= value.strip().lower() in ROLES if m[1].lower() == "role" else any(map(marks, value.split()))
            names.append(re.sub(r"[^a-z]+", "-", value.lower()))
        if names:
            label = f"{label}.{'.'.join(names)}"
    return Node(tag, label + "!" * marked, marked)


def parse(page: str) -> list[Node]:
    """The elements in page order, the root first; children are nodes and text. Unmarked inline elements give no node:
    what they hold is their parent's. Unclosed and stray tags are settled by HTML's implied ends."""
    root = Node("html", "html", False)
    every, stack, open_tags, at, end = [root], [("html", root)], Counter(), 0, len(page)

    def close(k: int) -> None:
        for tag, _ in stack[k:]:
            open_tags[tag] -= 1
        del stack[k:]

    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        tag, attrs, closing = m["tag"] or m["tag2"], m["attrs"] or m["attrs2"] or "", m["end"] or m["end2"]
        if tag is None:
            text = m.group()
            if text[0] != "<" or text == "<":
                text = entities.unescape(text) if "&" in text else text
                stack[-1][1].children.append(Link(text) if open_tags["a"] else text)
            elif text.startswith("<![CDATA["):
                stack[-1][1].children.append(text[9:-3])
            continue
        tag = tag.lower()
        if closing:
            if open_tags[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P and open_tags["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if tag in CLOSES and any(open_tags[x] for x in CLOSES[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in CLOSES[tag]:
                    close(k)
                if stack[min(k, len(stack) - 1)][0] in SCOPES:
                    break
        if tag == "br":
            stack[-1][1].children.append(" ")
            continue
        node, holder = _element(tag, attrs), stack[-1][1]
        if tag == "header" and not node.marked and not open_tags["article"] and not open_tags["main"]:  # the page's, not an article's
            node = Node(tag, node.label + "!", True)
        if tag in INLINE and not node.marked:
            node = holder
        else:
            holder.children.append(node)
            every.append(node)
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            node.children.append(page[at : found.start() if found else end])
            at = found.end() if found else end
        elif tag not in VOID and not attrs.endswith("/"):
            stack.append((tag, node))
            open_tags[tag] += 1
    return every


def _signed(every: list[Node]) -> str:
    """Number equal subtrees alike (runs of equal siblings count once), and give the root's tree as text."""
    number: dict[tuple, int] = {}
    inner_of: list[tuple[str, list[int], int]] = []
    for node in reversed(every):
        inner, size = [], 1
        for x in node.children:
            if isinstance(x, Node) and (not inner or x.sig != inner[-1]):
                inner.append(x.sig)
                size += x.size
        key = (node.label, *inner)
        if key not in number:
            number[key] = len(inner_of)
            inner_of.append((node.label, inner, size))
        node.sig, node.size = number[key], size
    out, todo = [], [every[0].sig]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        label, inner, _ = inner_of[x]
        out += [label, "("]
        todo.append(")")
        for k, y in enumerate(reversed(inner)):
            todo += [",", y] if k else [y]
    return "".join(out)


def blocks(page: str) -> tuple[str, list[int], list[str], list[bool], list[bool], list[int]]:
    """The skeleton, and for each text block in page order its skeleton node, its text, whether it stands in a marked
    element, whether it stands in the page's main element (article, or main), and its code points outside links."""
    every = parse(page)
    skeleton = _signed(every)
    nodes, texts, marks_, mains, plain = [], [], [], [], []
    # a frame: the node's children that are left, its number, its text so far, its last child's signature and number,
    # the next child's number, whether it is marked, and the kind of main element that it stands in
    frames = [[iter(every[0].children), 0, [], None, 1, 1, False, 0]]
    while frames:
        frame = frames[-1]
        x = next(frame[0], None)
        if isinstance(x, str):
            frame[2].append(x)
            continue
        text, linked = " ".join("".join(frame[2]).split()), sum(len(x) for x in frame[2] if isinstance(x, Link))
        frame[2].clear()
        if text:
            nodes.append(frame[1])
            texts.append(text)
            marks_.append(frame[6])
            mains.append(frame[7])
            plain.append(max(0, len(text) - linked))
        if x is None:
            frames.pop()
            continue
        if x.sig != frame[3]:
            frame[3], frame[4] = x.sig, frame[5]
            frame[5] += x.size
        marked = frame[6] or x.marked
        kind = 0 if marked else 2 if x.tag == "article" else 1 if x.tag == "main" else 0
        frames.append([iter(x.children), frame[4], [], None, 0, frame[4] + 1, marked, max(frame[7], kind)])
    best = max((m for m, marked in zip(mains, marks_) if not marked), default=0)
    return skeleton, nodes, texts, marks_, [best > 0 and m >= best for m in mains], plain


def tree_of(skeleton: str) -> tuple[list[str], list[int]]:
    """Labels and parents (-1 for the root) of the skeleton's nodes, in preorder."""
    labels, parents, stack, start = [], [], [], 0
    for m in re.finditer(r"[(),]", skeleton):
        c, at = m.group(), m.start()
        if c == "(":
            labels.append(skeleton[start:at])
            parents.append(stack[-1] if stack else -1)
            stack.append(len(labels) - 1)
        elif c == ")":
            stack.pop()
        start = at + 1
    return labels, parents


class Forest:
    """Trees, equal subtrees numbered alike: label, children and size of each number."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.label, self.inner, self.size = [], [], []

    def add(self, labels: list[str], parents: list[int]) -> tuple[list[int], list[list[int]]]:
        """Numbers and children of the nodes, in preorder."""
        children: list[list[int]] = [[] for _ in labels]
        for i, p in enumerate(parents):
            if p >= 0:
                children[p].append(i)
        own = [0] * len(labels)
        for i in range(len(labels) - 1, -1, -1):
            inner = [own[x] for x in children[i]]
            key = (labels[i], *inner)
            if key not in self.number:
                self.number[key] = len(self.label)
                self.label.append(labels[i])
                self.inner.append(inner)
                self.size.append(1 + sum(self.size[x] for x in inner))
            own[i] = self.number[key]
        return own, children


def _shared(a: tuple[list[str], list[int]], b: tuple[list[str], list[int]]) -> list[list[int]]:
    """The nodes of each of two trees (labels, parents) whose labels from the root on occur in the other."""
    number: dict[tuple[int, str], int] = {}
    paths = []
    for labels, parents in (a, b):
        own: list[int] = []
        for label, p in zip(labels, parents):
            own.append(number.setdefault((own[p] if p >= 0 else -1, label), len(number)))
        paths.append(own)
    both = set(paths[0]) & set(paths[1])
    return [[i for i, x in enumerate(own) if x in both] for own in paths]


def _part(tree: tuple[list[str], list[int]], kept: list[int]) -> tuple[list[str], list[int]]:
    new = {i: k for k, i in enumerate(kept)}
    return [tree[0][i] for i in kept], [new[tree[1][i]] if tree[1][i] >= 0 else -1 for i in kept]


def _middle(xs: list[int], ys: list[int]) -> tuple[int, int]:
    """Lengths of the common beginning and of the common end: equal subtrees there are matched in a best alignment."""
    least = min(len(xs), len(ys))
    a = next((k for k in range(least) if xs[k] != ys[k]), least)
    b = next((k for k in range(least - a) if xs[-1 - k] != ys[-1 - k]), least - a)
    return a, b


def _aligned(rows: Iterable[np.ndarray], n: int) -> list[tuple[int, int]]:
    """The pairs of two lists that keep the order of both and have the largest sum of weights. rows: for each element of
    the first list its weights with the n elements of the second; of each cell of the table only two bits are kept."""
    prior, diagonal, up = np.zeros(n + 1, dtype=np.int64), [], []
    for w in rows:
        met = prior[:-1] + w
        row = np.concatenate([[0], np.maximum.accumulate(np.maximum(prior[1:], met))])
        diagonal.append(np.packbits((w > 0) & (row[1:] == met)))
        up.append(np.packbits(row[1:] == prior[1:]))
        prior = row
    pairs, k, q = [], len(diagonal) - 1, n - 1
    while k >= 0 and q >= 0:
        byte, bit = q >> 3, 7 - (q & 7)
        if diagonal[k][byte] >> bit & 1:
            pairs.append((k, q))
            k, q = k - 1, q - 1
        elif up[k][byte] >> bit & 1:
            k -= 1
        else:
            q -= 1
    return pairs[::-1]


class _Level:
    """The subtrees of two trees that may meet at one path of labels from the root: their numbers, and the levels below by
    label. Codes number the other tree's subtrees of all levels below; the last code is that of everything else."""

    def __init__(self, mine: set[int], other: set[int]):
        self.mine, self.other = sorted(mine), sorted(other)
        self.column = {y: k for k, y in enumerate(self.other)}
        self.below: dict[str, tuple[int, int]] = {}  # label to level and first code
        self.codes, self.groups, self.rows = 0, [], {}


class Matching:
    """Simple tree matching of subtrees of a forest: sizes of the largest matchings, row by row. A row holds those of one
    subtree with all of the other tree at the same path, side by side; rows of the largest levels, beyond HELD cells in
    all, are made again when they are asked for, so that memory is bounded and no result depends on it."""

    def __init__(self, forest: Forest, x: int, y: int):
        self.forest, self.levels = forest, [_Level({x}, {y})]
        for level in self.levels:  # grows
            self._open(level)
        cells = [len(level.mine) * len(level.other) for level in self.levels]
        order = np.argsort(cells, kind="stable")
        held = set(order[np.cumsum(np.array(cells)[order]) <= HELD].tolist())
        for k in range(len(self.levels) - 1, -1, -1):
            if k in held:
                self.levels[k].rows = {p: self._row(self.levels[k], p) for p in self.levels[k].mine}

    def _children(self, level: _Level, x: int) -> list[int]:
        """What a subtree's matching depends on: without the equal ends, where only one pair meets."""
        xs = self.forest.inner[x]
        if len(level.mine) == len(level.other) == 1:
            head, tail = _middle(self.forest.inner[level.mine[0]], self.forest.inner[level.other[0]])
            return xs[head : len(xs) - tail]
        return xs

    def _open(self, level: _Level) -> None:
        label = self.forest.label
        sides: list[dict[str, set[int]]] = [{}, {}]
        if level.mine != level.other or len(level.mine) > 1:
            for kinds, found in zip((level.mine, level.other), sides):
                for x in kinds:
                    for c in self._children(level, x):
                        found.setdefault(label[c], set()).add(c)
        for name in sides[0]:
            if name in sides[1]:
                level.below[name] = (len(self.levels), level.codes)
                level.codes += len(sides[1][name])
                self.levels.append(_Level(sides[0][name], sides[1][name]))
        # the other tree's subtrees in groups of about as many children, as codes
        wide: dict[int, list[tuple[int, list[int]]]] = {}
        for k, y in enumerate(level.other):
            found = [c for c in self.codes(level, self._children(level, y)) if c < level.codes]
            if found:
                wide.setdefault(len(found).bit_length(), []).append((k, found))
        for members in wide.values():
            most = max(len(f) for _, f in members)
            level.groups.append((np.array([k for k, _ in members]), np.array([f + [level.codes] * (most - len(f)) for _, f in members])))

    def codes(self, level: _Level, ys: list[int]) -> list[int]:
        out = []
        for y in ys:
            at, first = level.below.get(self.forest.label[y], (-1, 0))
            own = self.levels[at].column.get(y) if at >= 0 else None
            out.append(level.codes if own is None else first + own)
        return out

    def weights(self, level: _Level, x: int) -> np.ndarray | None:
        """The largest matchings of x, a child at that level, by code; None if nothing there has its label."""
        at, first = level.below.get(self.forest.label[x], (-1, 0))
        if at < 0:
            return None
        out = np.zeros(level.codes + 1, dtype=np.int64)
        own = self.levels[at]
        out[first : first + len(own.other)] = own.rows[x] if x in own.rows else self._row(own, x)
        return out

    def _row(self, level: _Level, x: int) -> np.ndarray:
        forest, out = self.forest, np.ones(len(level.other), dtype=np.int32)
        tables = [np.zeros((len(g), w.shape[1] + 1), dtype=np.int64) for g, w in level.groups]
        for c in self._children(level, x):
            w = self.weights(level, c)
            if w is None:
                continue
            for table, (_, codes) in zip(tables, level.groups):
                np.maximum.accumulate(np.maximum(table[:, 1:], table[:, :-1] + w[codes]), axis=1, out=table[:, 1:])
        for table, (at, _) in zip(tables, level.groups):
            out[at] += table[:, -1].astype(np.int32)
        if len(level.mine) == len(level.other) == 1:
            xs = forest.inner[x]
            head, tail = _middle(xs, forest.inner[level.other[0]])
            out += sum(forest.size[v] for v in (*xs[:head], *xs[len(xs) - tail :]))
        if x in level.column:
            out[level.column[x]] = forest.size[x]
        return out


@lru_cache(maxsize=512)
def align(skeleton: str, reference: str) -> tuple[int, ...]:
    """For each node of skeleton the matched node of reference, or -1: simple tree matching, where nodes match if
    their labels do and their parents match, and children keep their order."""
    ours, theirs = tree_of(skeleton), tree_of(reference)
    a_kept, b_kept = _shared(ours, theirs)
    out = [-1] * len(ours[0])
    if not a_kept:
        return tuple(out)
    forest = Forest()
    (a, a_children), (b, b_children) = forest.add(*_part(ours, a_kept)), forest.add(*_part(theirs, b_kept))
    matching = Matching(forest, a[0], b[0])

    todo = [(0, 0, 0)]
    while todo:
        i, j, at = todo.pop()
        if a[i] == b[j]:
            for k in range(forest.size[a[i]]):
                out[a_kept[i + k]] = b_kept[j + k]
            continue
        out[a_kept[i]] = b_kept[j]
        level, xs, ys = matching.levels[at], a_children[i], b_children[j]
        mine, other = forest.inner[a[i]], forest.inner[b[j]]
        head, tail = _middle(mine, other)
        mine, other = mine[head : len(mine) - tail], other[head : len(other) - tail]
        codes, none = np.array(matching.codes(level, other), dtype=np.int64), np.zeros(len(other), dtype=np.int64)
        rows = (none if w is None else w[codes] for w in (matching.weights(level, x) for x in mine))
        pairs = _aligned(rows, len(other)) if mine and other else []
        todo += [*zip(xs[:head], ys[:head], [0] * head), *((xs[head + k], ys[head + q], level.below[forest.label[mine[k]]][0]) for k, q in pairs), *zip(xs[len(xs) - tail :], ys[len(ys) - tail :], [0] * tail)]
    return tuple(out)


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _held(to: tuple[int, ...], nodes: list[int], digests: list[int], marked: list[bool], plain: list[int]) -> dict[int, tuple[int, int]]:
    """Digest of the unmarked text that each reference node holds on a page, and its code points outside links."""
    joined: dict[int, tuple[int, int]] = {}
    for n, d, m, k in zip(nodes, digests, marked, plain):
        if to[n] >= 0 and not m:
            before, size = joined.get(to[n], (0, 0))
            joined[to[n]] = ((before * 1_000_003 + d) & 0x7FFFFFFFFFFFFFFF, size + k)
    return joined


def main_part(reference: str, slots: dict[int, int]) -> tuple[int, int]:
    """The nodes (first, end) of the reference's main part: the deepest one with a share of MAIN of the slots' text, and
    with the first slot that is a heading of the highest rank. slots: code points outside links by node."""
    labels, parents = tree_of(reference)
    size, mass = [1] * len(labels), [slots.get(i, 0) for i in range(len(labels))]
    for i in range(len(labels) - 1, 0, -1):
        size[parents[i]] += size[i]
        mass[parents[i]] += mass[i]
    headings = sorted((labels[i][:2], i) for i in slots if re.match(r"h[1-6]\b", labels[i]))
    title = headings[0][1] if headings else None
    at = 0
    while mass[0]:
        inside = [i for i in range(at + 1, at + size[at]) if parents[i] == at and mass[i] >= MAIN * mass[0] and (title is None or i <= title < i + size[i])]
        # without a heading, a node of text alone is part of what stands around it
        if not inside or title is None and size[inside[0]] == 1:
            break
        at = inside[0]
    return at, at + size[at]


def _inside(to: tuple[int, ...], skeleton: str, part: tuple[int, int]) -> list[bool]:
    """Whether each node of a page's skeleton, or the nearest node above it that is aligned, is in the main part."""
    out: list[bool] = []
    for i, p in enumerate(tree_of(skeleton)[1]):
        out.append(part[0] <= to[i] < part[1] if to[i] >= 0 else p >= 0 and out[p])
    return out


def _kept(to: tuple[int, ...], skeleton: str, template: dict[int, int], part: tuple[int, int] | None, nodes, digests, texts, marked, main, plain) -> list[str]:
    """The page's main text: see the module. part: the main part that the host's slots tell, if they do."""
    if not any(main):
        inside = _inside(to, skeleton, part) if part else [True] * len(to)
        main = [inside[n] for n in nodes]
        if not any(i and not m for i, m in zip(main, marked)):
            main = [True] * len(nodes)
    held = _held(to, nodes, digests, marked, plain)
    constant = [to[n] in template and not m and template[to[n]] == held[to[n]][0] for n, m in zip(nodes, marked)]
    if all(c for c, i, m in zip(constant, main, marked) if i and not m):
        constant = [c and not i for c, i in zip(constant, main)]
    return [t for t, c, m, i in zip(texts, constant, marked, main) if i and not m and not c]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row of pages, repeated rows included. A null page counts as empty, null urls
    are one host of their own; a page without main text has an empty text. Other columns aren't read."""
    kind = dict(pages.dtypes)[id_col]
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), _host(pages[url_col]).alias("host"), F.coalesce(pages[html_col], F.lit("")).alias("html"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "html", rows=500):
            found = [blocks(h) for h in batch.column("html").to_pylist()]
            columns = [*(batch.column(c) for c in ("id", "url", "host")), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.list_(pa.int32()))]
            columns.append(pa.array([[_digest(t) for t in x[2]] for x in found], pa.list_(pa.int64())))
            columns += [pa.array([x[2] for x in found], pa.list_(pa.string())), pa.array([x[3] for x in found], pa.list_(pa.bool_())), pa.array([x[4] for x in found], pa.list_(pa.bool_())), pa.array([x[5] for x in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "url", "host", "skeleton", "nodes", "digests", "texts", "marked", "main", "plain"])

    found = rows.mapInArrow(parsed, f"id {kind}, url string, host string, skeleton string, nodes array<int>, digests array<long>, texts array<string>, marked array<boolean>, main array<boolean>, plain array<int>")
    found = written(found, "blocks")
    # copies count once, whatever their menus: pages are told apart by their unmarked texts
    page = F.xxhash64(F.expr("transform(filter(arrays_zip(digests, marked), x -> not x.marked), x -> x.digests)"))
    distinct = found.select("host", "skeleton", page.alias("page")).distinct()
    shapes = distinct.groupBy("host", "skeleton").agg(F.count("*").alias("n"))
    references = shapes.groupBy("host").agg(F.max_by("skeleton", F.struct("n", "skeleton")).alias("reference"))
    references = written(references, "references")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "skeleton"):
            hosts, at, held = [], [], []
            for host, s, ref, *columns in zip(*(batch.column(c).to_pylist() for c in ("host", "skeleton", "reference", "nodes", "digests", "marked", "plain"))):
                joined = _held(align(s, ref), *columns)
                hosts += [host] * len(joined)
                at += joined
                held += joined.values()
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(at, pa.int32()), pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int64())], names=["host", "node", "digest", "plain"])

    single = found.withColumn("page", page)
    single = single.groupBy("host", "page").agg(F.min_by(F.struct("skeleton", "nodes", "digests", "marked", "plain"), F.struct("skeleton", "nodes", "digests")).alias("p")).select("host", "p.*")
    slots = single.join(references, "host").mapInArrow(aligned, "host string, node int, digest long, plain long")
    texts = slots.groupBy("host", "node", "digest").agg(F.count("*").alias("n"), F.sum("plain").alias("plain"))
    per_node = texts.groupBy("host", "node").agg(F.max(F.struct("n", "digest")).alias("most"), F.sum("n").alias("pages"), F.sum("plain").alias("plain"))
    same = F.col("most.n")
    learned = per_node.where(F.col("pages") >= PAGES).withColumn("digest", F.when((same >= PAGES) & (same >= SHARE * F.col("pages")), F.col("most.digest")))
    template = learned.groupBy("host").agg(F.collect_list(F.struct("node", "digest", "plain")).alias("learned"))
    wrappers = written(references.join(template, "host", "left"), "wrappers")

    def main_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "skeleton", rows=500):
            out, parts = [], {}
            for host, s, ref, learned, *columns in zip(*(batch.column(c).to_pylist() for c in ("host", "skeleton", "reference", "learned", "nodes", "digests", "texts", "marked", "main", "plain"))):
                template = {x["node"]: x["digest"] for x in learned or () if x["digest"] is not None}
                if learned and host not in parts:
                    parts[host] = main_part(ref, {x["node"]: x["plain"] for x in learned if x["digest"] is None})
                out.append("\n".join(_kept(align(s, ref), s, template, parts.get(host), *columns)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    fields = found.select("id", "url", "host", "skeleton", "nodes", "digests", "texts", "marked", "main", "plain").join(wrappers, "host")
    return fields.mapInArrow(main_text, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
