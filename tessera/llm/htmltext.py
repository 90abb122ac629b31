"""Operator 10: main text of web pages by wrapper induction.

1. A host's pages are told apart by layout - the elements below the body and
   below its containers - and each layout has a wrapper of its own.  It is fitted
   on all different pages of the layout; the one with the smallest content hash is
   the seed that the others are aligned with.
2. The seed's DOM tree is aligned with each other one by simple tree
   matching: nodes match if tag, class and id agree, and the number of matched
   pairs is maximised over the ordered children by dynamic programming, for nodes
   of any size.  Equal subtrees are told by their shapes: two of one shape match
   whole, the same ones at the beginning of two lists of children are paired
   without a table, and tables of many children are made of arrays, for all
   different shapes among them at once.  Of a large table some rows are held and the
   others made again on the way back, so pages of any size and depth train.
3. Matched text that is the same on ``SAME_SHARE`` of the pages (on all, where they
   are fewer than ten) is template; text that varies, and nodes without a partner,
   are slots.  Pages are aligned where they are; only which of the seed's texts
   they agree with is gathered and counted.  Slots in elements that are no content by
   kind (menus, headers, footers, forms and so on, by element or by a class or id
   that says so) and slots that are mostly links are no content.
4. From the body downwards, the wrapper follows the container that holds nearly
   all of the content slots.  The wrapper is this node's path, and the template
   texts below it.
5. A page's text is what its wrapper's node holds, without template texts and
   without elements that are no content by kind.  ``article`` elements (``main``
   where there is none) outside one another hold the text where a page has them,
   but only those of one place: lists of reader comments and of teasers are
   articles too, below containers of their own.  The place is the one that most
   of the layout's different pages agree on, each by its main heading and then by
   the most text outside links; a page that lacks it decides for itself.

Inside an article a class or id takes an element out only if it says nothing
else: ``cookie-notice`` does, ``cookie-recipes`` does not.  Elsewhere any part of a
name will do.  An article inside an article goes by its class as other elements do.

Template texts are taken out only if ``LEAST_PAGES`` different pages agree on
them and the content varies more than it agrees (near copies of one page say
nothing about templates).

Text: character references are decoded, white space inside a block becomes one
space and is trimmed, blocks are joined in page order by one space.

Null pages count as empty.  A page whose url is null or has no host belongs to
the host "".  Repeated rows give repeated results, null ids stay, an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import json
import math
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow

#: Share of a layout's different pages that a template text is the same on.
SAME_SHARE = 0.9
#: Tables of more cells than this are made of arrays, those of more than that are not held whole.
WIDE, HELD_CELLS = 1_000, 4_000_000
#: Template texts are removed only if at least this many pages agree on them.
LEAST_PAGES = 3
DESCENT_SHARE = 0.8
LINK_SHARE = 0.5
#: Seeds and wrappers are broadcast up to this many characters in all, else joined by host and layout.
BROADCAST_CHARS = 8_000_000
#: Memory of a task: parsed seeds or wrappers, contents met, shapes and their alignments; what was forgotten is made again.
HELD, HELD_CHARS = 10_000, 16_000_000
#: Pairs of nodes and of their parts in the alignments held while two pages are aligned.
HELD_PAIRS = 500_000

# Fixed values of HTML: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math select option".split())
NEVER = frozenset("script style head title noscript template iframe svg math nav footer aside form button select option textarea input menu dialog object canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CONTAINERS = frozenset("body article main section div table tbody tr td center".split())
CLOSES = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody"]),
    "td": frozenset(["td", "th", "tr", "tbody"]),
    "th": frozenset(["td", "th", "tr", "tbody"]),
    "option": frozenset(["option"]),
}
#: Fixed words of class and id values.  The first mark boilerplate as any part of a name, the others only as the whole name of a block.
BOILERPLATE = frozenset("ad ads advert adverts advertisement breadcrumb breadcrumbs comments cookie cookies disqus footer gdpr masthead menu navbar newsletter pagination sidebar sponsored toolbar topbar".split())
BOILERPLATE_NAMES = frozenset("banner comment consent header modal nav navigation notice notices pager popup promo related replies reply respond response responses share sharing social sponsor subscribe teaser teasers widget widgets".split())
#: Words that say nothing about what an element holds.
NEUTRAL = frozenset("area bar block box container content group inner item items js left list outer panel right row section top unit wrap wrapper".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_MARK = re.compile(r"(?<![\w-])(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "mark", "words", "names", "children", "hidden", "solely")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.children, self.mark, self.words, self.names, self.hidden, self.solely = tag, [], "", frozenset(), frozenset(), False, False
        if attributes and not attributes.isspace():
            found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _MARK.finditer(attributes)}
            self.hidden = "hidden" in found
            self.mark = f"{found.get('id', '')}.{' '.join(sorted(found.get('class', '').split()))}" if found else ""
            names = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}"
            self.names = frozenset(names.lower().split())
            self.words = frozenset(_WORDS.findall(_HUMP.sub("-", names).lower()))
            if self.words & BOILERPLATE or self.words & BOILERPLATE_NAMES:
                said = [set(_WORDS.findall(_HUMP.sub("-", name).lower())) for name in names.split()]
                self.solely = any(w & (BOILERPLATE | BOILERPLATE_NAMES) and w <= BOILERPLATE | BOILERPLATE_NAMES | NEUTRAL for w in said)

    @property
    def label(self) -> str:
        return f"{self.tag}|{self.mark}"

    def boilerplate(self, in_article: bool = False) -> bool:
        if self.tag in NEVER or self.hidden or (self.tag == "header" and not in_article):
            return True
        if self.tag in INLINE or self.tag in ("html", "body", "main") or (self.tag == "article" and not in_article):
            return False
        if in_article:
            return self.solely
        return bool(self.words & BOILERPLATE or self.names & BOILERPLATE_NAMES)


def parse(page: str) -> Node:
    """A tolerant DOM tree; children are nodes and undecoded texts."""
    root = Node("#root")
    stack, at, n = [root], 0, len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        if found is None:
            stack[-1].children.append(page[at:])
            break
        if found.start() > at:
            stack[-1].children.append(page[at : found.start()])
        at = found.end()
        if (tag := found[2]) is None:
            continue
        tag = tag.lower()
        if found[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        for depth in range(len(stack) - 1, 0, -1):
            above = stack[depth].tag
            if tag in CLOSES.get(above, ()):
                del stack[depth:]
                break
            if above in ("table", "ul", "ol", "div", "article", "section", "td", "body") or (above not in INLINE and above not in CLOSES):
                break
        node = Node(tag, found[3])
        stack[-1].children.append(node)
        if tag in VOID or found[3].endswith("/") and tag not in ("p", "div", "a", "span"):
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        stack.append(node)
    return root


def blocks(node: Node, in_article: bool = False) -> Iterator[str]:
    """Decoded texts of a node's blocks in page order, without boilerplate below it."""
    held: list[str] = []

    def flush() -> Iterator[str]:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            yield text

    todo: list = [iter(node.children)]
    ends = [False]
    inside = [in_article or node.tag in ("article", "main")]
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
            inside.pop()
            if ends.pop():
                yield from flush()
        elif isinstance(child, str):
            held.append(child)
        elif child.tag in ("br", "hr"):
            held.append(" ")
        elif child.boilerplate(inside[-1]):
            if child.tag not in INLINE:
                yield from flush()
        else:
            block = child.tag not in INLINE
            if block:
                yield from flush()
            todo.append(iter(child.children))
            ends.append(block)
            inside.append(inside[-1] or child.tag in ("article", "main"))
    yield from flush()


def find(node: Node, tag: str) -> Node | None:
    todo = [node]
    while todo:
        now = todo.pop()
        if now.tag == tag:
            return now
        todo += [c for c in reversed(now.children) if isinstance(c, Node)]
    return None


def places(node: Node, tag: str) -> dict[tuple[str, ...], list[Node]]:
    """The elements of a kind that are not inside one another or inside what is no content, by the labels above them, in page order."""
    out: dict[tuple[str, ...], list[Node]] = {}
    todo: list[tuple[Node, tuple[str, ...]]] = [(node, ())]
    while todo:
        now, above = todo.pop()
        if now.tag == tag:
            out.setdefault(above, []).append(now)
        elif now is node or not now.boilerplate(now.tag in ("article", "main")):
            below = (*above, now.label)
            todo += [(c, below) for c in reversed(now.children) if isinstance(c, Node)]
    for own in out.values():  # comments and teasers beside what they belong to
        if any(not n.solely for n in own):
            own[:] = [n for n in own if not n.solely]
    return out


def weight(nodes: list[Node]) -> tuple[int, int]:
    """Main headings in some elements, and the characters of their text outside links."""
    heads = size = 0
    todo = [(n, True) for n in nodes]
    while todo:
        now, inside = todo.pop()
        heads += now.tag == "h1"
        for child in now.children:
            if isinstance(child, str):
                size += len(child.strip())
            elif child.tag != "a" and not child.boilerplate(inside):
                todo.append((child, inside))
    return heads, size


def chosen_place(found: dict[tuple[str, ...], list[Node]]) -> tuple[str, ...] | None:
    """The place whose elements have a main heading, of these or of all the one with the most text."""
    return max(found, key=lambda p: (weight(found[p])[0] > 0, weight(found[p])[1]), default=None) if len(found) != 1 else next(iter(found))


def layout(body: Node) -> str:
    """The labels below the body and below its containers, without repeats, however often they occur."""
    found = set()
    for child in body.children:
        if isinstance(child, Node) and not child.boilerplate():
            found.add(child.label)
            if child.tag in CONTAINERS and child.tag not in ("article", "main"):
                found |= {f"{child.label}/{c.label}" for c in child.children if isinstance(c, Node) and c.tag in CONTAINERS and not c.boilerplate()}
    return " ".join(sorted(found))


def parts(node: Node | Shape) -> list:
    """A node's children for alignment: nodes and non-blank texts, each text as a leaf."""
    return [c for c in node.children if not isinstance(c, str) or c.strip()]


class Shape:
    """What alignment sees of a subtree: labels, and where texts are."""

    __slots__ = ("label", "children", "size")

    def __init__(self, label: str, children: tuple) -> None:
        self.label, self.children, self.size = label, children, 1 + sum(1 if isinstance(c, str) else c.size for c in children)


class Memo(dict):
    """The alignments so far; all are forgotten, to be made again, where they become too many."""

    weight = 0

    def __setitem__(self, key: tuple[int, int], value: tuple[int, list[tuple[int, int]]]) -> None:
        self.weight += 1 + len(value[1])
        if self.weight > HELD_PAIRS:
            self.clear()
            self.weight = 1 + len(value[1])
        super().__setitem__(key, value)

    def clear(self) -> None:
        super().clear()
        self.weight = 0


class Held(dict):
    """Gains so far, in arrays of at most ``HELD_CELLS`` cells."""

    cells = 0

    def keep(self, key: tuple[int, int], value: np.ndarray) -> None:
        self.cells += len(value)
        if self.cells > HELD_CELLS:
            self.clear()
            self.cells = len(value)
        self[key] = value


class Shapes:
    """Equal subtrees as one shape, and the alignments of shapes so far: a layout's pages share most of them."""

    def __init__(self) -> None:
        self.known: dict[tuple, Shape] = {}
        self.memo = Memo()

    def trim(self) -> None:
        if len(self.known) > HELD or len(self.memo) > HELD:
            self.known.clear(), self.memo.clear()

    def of(self, root: Node) -> dict[int, Shape]:
        """The shapes of all nodes of a tree by the nodes' ids."""
        order, todo = [], [root]
        while todo:
            now = todo.pop()
            order.append(now)
            todo += [c for c in now.children if isinstance(c, Node)]
        found: dict[int, Shape] = {}
        for node in reversed(order):
            children = tuple([found[id(c)] if isinstance(c, Node) else "x" for c in parts(node)])
            key = (node.label, tuple(map(id, children)))  # shapes below are known, so their ids stand for them
            if (shape := self.known.get(key)) is None:
                shape = self.known[key] = Shape(node.label, children)
            found[id(node)] = shape
        return found


def _aligned(a, b, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Size of the largest order-keeping matching of two trees with their roots, and which of the roots' parts it pairs."""
    if (key := (id(a), id(b))) in memo:
        return memo[key]
    left, right = parts(a), parts(b)
    head = gained = 0
    if isinstance(a, Shape):  # equal parts at the beginning gain all they can, so the matching has them
        while head < min(len(left), len(right)) and left[head] is right[head]:
            gained += 1 if isinstance(left[head], str) else left[head].size
            head += 1
    size, chosen = (_wide if (len(left) - head) * (len(right) - head) > WIDE else _narrow)(left[head:], right[head:], memo)
    found = 1 + gained + size, [*((i + head, j + head) for i, j in chosen), *((i, i) for i in reversed(range(head)))]
    memo[key] = found
    return found


def _narrow(left: list, right: list, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Size and pairs, last ones first, of the largest order-keeping matching of two lists of trees."""
    table = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + matched(x, y, memo))
    chosen, i, j = [], len(left), len(right)
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            chosen.append((i, j))
    return table[-1][-1], chosen


class Kinds:
    """Different trees, and what another tree gains with each of them: a row of each one's table at a time, for all of them at once."""

    def __init__(self, trees: list, held: Held) -> None:
        self.kinds: dict[int, int] = {}
        self.labelled: dict[str, list[tuple[int, object]]] = {}
        self.ready: dict[str, list[tuple[np.ndarray, np.ndarray, Kinds]]] = {}
        self.held = held
        for tree in trees:
            if (key := 0 if isinstance(tree, str) else id(tree)) not in self.kinds:
                if key:
                    self.labelled.setdefault(tree.label, []).append((len(self.kinds), tree))
                self.kinds[key] = len(self.kinds)

    def place(self, trees: list, size: int = 0) -> np.ndarray:
        """The trees' numbers, filled up with the number that gains nothing."""
        found = [self.kinds[0 if isinstance(t, str) else id(t)] for t in trees]
        return np.array(found + [len(self.kinds)] * (size - len(found)), np.int32)

    def groups(self, label: str) -> list[tuple[np.ndarray, np.ndarray, Kinds]]:
        """The trees of a label by how many parts they have: their numbers, those of their parts, and the parts' kinds."""
        if label not in self.ready:
            sizes: dict[int, list[tuple[int, list]]] = {}
            for k, tree in self.labelled.get(label, ()):
                own = parts(tree)
                sizes.setdefault(len(own).bit_length(), []).append((k, own))
            self.ready[label] = []
            for trees in sizes.values():
                longest, inner = max(len(own) for _, own in trees), Kinds([t for _, own in trees for t in own], self.held)
                self.ready[label].append((np.array([k for k, _ in trees]), np.array([inner.place(own, longest) for _, own in trees]), inner))
        return self.ready[label]

    def gains(self, tree) -> np.ndarray:
        """Size of the matching of a tree with each of the trees; nothing at the end."""
        key = (id(self), 0 if isinstance(tree, str) else id(tree))
        if key in self.held:
            return self.held[key]
        own = np.zeros(len(self.kinds) + 1, np.int32)
        if isinstance(tree, str):
            if 0 in self.kinds:
                own[self.kinds[0]] = 1
        else:
            for which, place, inner in self.groups(tree.label):
                table = np.zeros((len(which), place.shape[1] + 1), np.int32)
                for part in parts(tree):
                    if len(inner.kinds) and (gained := inner.gains(part)).any():
                        np.maximum(table[:, 1:], table[:, :-1] + gained[place], out=table[:, 1:])
                        np.maximum.accumulate(table, axis=1, out=table)
                own[which] = 1 + table[:, -1]
        self.held.keep(key, own)
        return own


def _wide(left: list, right: list, _: dict) -> tuple[int, list[tuple[int, int]]]:
    """The same of long lists: rows of the table are arrays, and a block of them is held."""
    kinds = Kinds(right, Held())
    place = kinds.place(right)

    def below(above: np.ndarray, x) -> np.ndarray:
        row = np.zeros_like(above)
        np.add(above[:-1], kinds.gains(x)[place], out=row[1:])
        np.maximum(row, above, out=row)
        return np.maximum.accumulate(row, out=row)

    step = max(HELD_CELLS // (len(right) + 1), math.isqrt(len(left)), 1)
    held, block = [], [np.zeros(len(right) + 1, np.int32)]
    for i, x in enumerate(left):
        if i and i % step == 0:
            held.append(block[0])
            block = block[-1:]
        block.append(below(block[-1], x))
    size = int(block[-1][-1])
    chosen, i, j, first = [], len(left), len(right), len(held) * step
    while i and j:
        if i == first:
            first -= step
            block = [held.pop()]
            for x in left[first : first + step]:
                block.append(below(block[-1], x))
        now, above = block[i - first], block[i - first - 1]
        if now[j] == above[j]:
            i -= 1
        elif now[j] == now[j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            chosen.append((i, j))
    return size, chosen


def matched(a, b, memo: dict) -> int:
    """Size of the largest order-keeping matching of two trees with equal roots."""
    if isinstance(a, str) or isinstance(b, str):
        return int(isinstance(a, str) and isinstance(b, str))
    if a is b and isinstance(a, Shape):
        return a.size
    return _aligned(a, b, memo)[0] if a.label == b.label else 0


def pairs(a: Node, b: Node, shapes: Shapes | None = None) -> Iterator[tuple]:
    """Matched pairs of nodes and texts, from the roots (whatever these are) down."""
    return ((x, y) for x, y, _ in placed_pairs(a, b, shapes or Shapes()))


def placed_pairs(a: Node, b: Node, shapes: Shapes) -> Iterator[tuple]:
    """The pairs, each with where its first one is: the id of the node above and the place among its parts."""
    of_a, of_b = shapes.of(a), shapes.of(b)
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 4 * max(len(of_a), len(of_b)) + 1_000))
    try:
        todo: list[tuple] = [(a, b, None)]
        while todo:
            now = todo.pop()
            yield now
            x, y, _ = now
            if isinstance(x, str):
                continue
            left, right = parts(x), parts(y)
            met = _aligned(of_a[id(x)], of_b[id(y)], shapes.memo)[1]
            todo += [(left[i], right[j], (id(x), i)) for i, j in met]
    finally:
        sys.setrecursionlimit(limit)


def _plain(text: str) -> str:
    return " ".join(html.unescape(text).split())


class Seed:
    """The page that its layout's pages are aligned with; its texts have numbers."""

    def __init__(self, body: Node) -> None:
        self.body, self.order, self.number, self.texts = body, [], {}, []
        todo = [body]
        while todo:
            now = todo.pop()
            self.order.append(now)
            for k, part in enumerate(parts(now)):
                if isinstance(part, str):
                    self.number[id(now), k] = len(self.texts)
                    self.texts.append(_plain(part))
            todo += [c for c in reversed(now.children) if isinstance(c, Node)]

    def agreed(self, body: Node, shapes: Shapes) -> list[int]:
        """The numbers of the texts that another page has, the same, in the same place."""
        shapes.trim()
        met = ((self.number[where], y) for x, y, where in placed_pairs(self.body, body, shapes) if isinstance(x, str))
        return [n for n, y in met if self.texts[n] == y or self.texts[n] == _plain(y)]


def _places_of(body: Node) -> dict[str, tuple[str, ...]]:
    """Where a page's articles are, by kind of element."""
    found = {tag: chosen_place(places(body, tag)) for tag in ("article", "main")}
    return {tag: place for tag, place in found.items() if place is not None}


def _wrapper(seed: Seed, same: set[int], pages: int, agreed: dict[str, list[str]]) -> dict:
    """A layout's wrapper: ``path`` (labels from the body's child down), ``template`` texts and the articles' ``places``.

    ``same`` has the numbers of the texts that nearly all of its ``pages`` different pages agree on.
    """
    constant = same if pages > 1 else set()

    # characters of varying text outside boilerplate, those of them in links, and constant ones; children before parents
    order, todo = [], [(seed.body, False)]
    while todo:
        node, inside = todo.pop()
        if not node.boilerplate(inside):
            order.append(node)
            inside = inside or node.tag in ("article", "main")
            todo += [(c, inside) for c in node.children if isinstance(c, Node)]
    mass: dict[int, tuple[int, int, int]] = {}
    for node in reversed(order):
        total = links = fixed = 0
        for k, child in enumerate(parts(node)):
            if isinstance(child, Node):
                t, n, f = mass.get(id(child), (0, 0, 0))
                total, links, fixed = total + t, links + n, fixed + f
            elif seed.number[id(node), k] in constant:
                fixed += len(child.strip())
            else:
                total += len(child.strip())
        if node.tag == "a":
            links = total
        elif node.tag not in INLINE and total and links > LINK_SHARE * total:
            total = links = 0
        mass[id(node)] = (total, links, fixed)

    path, now = [], seed.body
    while now.tag not in ("article", "main"):
        own = [c for c in now.children if isinstance(c, Node)]
        best = max(own, key=lambda c: mass.get(id(c), (0, 0, 0))[0], default=None)
        if best is None or best.tag not in CONTAINERS or not mass[id(best)][0] or mass[id(best)][0] < DESCENT_SHARE * mass[id(now)][0]:
            break
        path.append([best.label, [c.label for c in own[: own.index(best)]].count(best.label)])
        now = best
    template: set[str] = set()
    varying, _, fixed = mass.get(id(now), (0, 0, 0))
    if pages >= LEAST_PAGES and varying > fixed:
        todo = [now]
        while todo:
            node = todo.pop()
            todo += [c for c in node.children if isinstance(c, Node)]
            template |= {seed.texts[n] for k in range(len(parts(node))) if (n := seed.number.get((id(node), k))) in constant}
    return {"path": path, "template": sorted(template), "places": agreed}


def body_of(page: str) -> Node | None:
    return find(parse(page), "body")


def induce(pages: list[str]) -> dict:
    """Wrappers of a host from its pages, by layout; the first page of a layout is its seed."""
    bodies: dict[str, list[Node]] = {}
    for page in dict.fromkeys(pages):
        if (body := body_of(page)) is not None:
            bodies.setdefault(layout(body), []).append(body)
    found = {}
    for name, own in bodies.items():
        seed, shapes, counted, voted = Seed(own[0]), Shapes(), Counter(), {"article": Counter(), "main": Counter()}
        for body in own:
            counted.update(seed.agreed(body, shapes))
            for tag, place in _places_of(body).items():
                voted[tag][place] += 1
        same = {n for n, c in counted.items() if c >= SAME_SHARE * len(own)}
        found[name] = _wrapper(seed, same, len(own), {tag: list(v.most_common(1)[0][0]) for tag, v in voted.items() if v})
    return found


def extract(page: str | None, wrappers: dict | None) -> str:
    """Main text of a page, by its layout's wrapper if there is one."""
    if not page:
        return ""
    root = parse(page)
    body = find(root, "body") or root
    return text_of(body, (wrappers or {}).get(layout(body)))


def text_of(body: Node, wrapper: dict | None) -> str:
    """Main text below a page's body."""
    wrapper = wrapper or {"path": (), "template": (), "places": {}}
    template, now = set(wrapper["template"]), body
    for label, number in wrapper["path"]:
        same = [c for c in now.children if isinstance(c, Node) and c.label == label]
        if len(same) <= number:
            now = None
            break
        now = same[number]
    # the articles of the page at the layout's place, wherever the path leads: it may end in one of several
    held = [now or body]
    for tag in ("article", "main"):
        if found := places(body, tag):
            agreed = tuple(wrapper["places"].get(tag, ()))
            held = found[agreed if agreed in found else chosen_place(found)]
            break
    return " ".join(b for node in held for b in blocks(node) if b not in template)


def host_of(url: str):
    """Host of a url column in lower case; the empty text if it has none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _digest(name: str) -> bytes:
    return hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _found_for(pages: DataFrame, found: DataFrame, column: str) -> tuple[DataFrame, Callable]:
    """``pages`` and a lookup: what a row's host and layout have in ``column`` of a checkpointed table.

    A small table goes to the tasks whole; from a large one each row brings its own,
    by a join for which the layouts are read from the pages once more.
    """
    context = pages.sparkSession.sparkContext
    size = found.agg(F.sum(F.length(column) + F.length("host") + 16)).head()[0] or 0
    if size <= BROADCAST_CHARS:
        small = context.broadcast({(r["host"], bytes(r["layout"])): r[column] for r in found.collect()})
        return pages.withColumn("brought", F.lit(None).cast("string")), lambda host, name, brought: small.value.get((host, name))
    schema = ", ".join(f"`{n}` {t}" for n, t in pages.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = (body_of(p or "") for p in batch.column("page").to_pylist())
            names = pa.array([None if b is None else _digest(layout(b)) for b in bodies], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, names], names=[*batch.schema.names, "layout"])

    rows = map_arrow(pages, work, f"{schema}, layout binary").join(found.withColumnRenamed(column, "brought"), ["host", "layout"], "left")
    return rows.drop("layout"), lambda host, name, brought: brought


def _seeds(own: DataFrame) -> DataFrame:
    """``host, layout, seed``: of each layout the page with the smallest content hash."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], tuple[bytes, str]] = {}
        names = ["host", "layout", "content", "seed"]
        types = [pa.string(), pa.binary(), pa.binary(), pa.string()]

        def out() -> pa.RecordBatch:
            rows = list(zip(*[(*key, *value) for key, value in held.items()], strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names=names)

        for batch in batches:
            for host, page, content in zip(*(batch.column(n).to_pylist() for n in ("host", "page", "content")), strict=True):
                if (body := body_of(page)) is not None:
                    key = (host, _digest(layout(body)))
                    if key not in held or content < held[key][0]:
                        held[key] = (content, page)
            if sum(len(page) for _, page in held.values()) > HELD_CHARS:
                yield out()
                held.clear()
        yield out()

    return map_arrow(own, least, "host string, layout binary, content binary, seed string").groupBy("host", "layout").agg(F.min_by("seed", "content").alias("seed"))


def _votes(own: DataFrame, seeds: DataFrame) -> DataFrame:
    """``host, layout, content, votes`` of pages: the page itself (empty), its texts that its layout's seed has, and its articles' places."""
    rows_, seed_of = _found_for(own, seeds, "seed")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Seed] = {}
        shapes, met, held = Shapes(), set(), 0
        for batch in batches:
            rows = []
            for host, content, page, brought in zip(*(batch.column(n).to_pylist() for n in ("host", "content", "page", "brought")), strict=True):
                if (host, content) in met or (body := body_of(page)) is None:
                    continue
                if len(met) >= HELD:
                    met.clear()
                met.add((host, content))
                name = _digest(layout(body))
                seed = seed_of(host, name, brought)
                if seed not in known:
                    if held > HELD_CHARS:
                        known.clear()
                        held = 0
                    known[seed] = Seed(body_of(seed))
                    held += len(seed)
                placed = [f"{tag}:{json.dumps(place)}" for tag, place in _places_of(body).items()]
                rows.append((host, name, content, ["", *map(str, known[seed].agreed(body, shapes)), *placed]))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            types = [pa.string(), pa.binary(), pa.binary(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["host", "layout", "content", "votes"])

    return map_arrow(rows_, work, "host string, layout binary, content binary, votes array<string>", 200)


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, layout, wrapper``: the wrapper, as JSON, of every layout of a host, from all its different pages."""
    page = F.coalesce(F.col(html_col), F.lit(""))
    own = pages.select(host_of(url_col).alias("host"), page.alias("page")).filter(F.col("page") != "").withColumn("content", F.unhex(F.sha2("page", 256)))
    seeds = cut(_seeds(own))
    different = _votes(own, seeds).dropDuplicates(["host", "layout", "content"])
    counted = different.select("host", "layout", "content", F.explode("votes").alias("vote")).groupBy("host", "layout", "vote").agg(F.count("*").alias("c"), F.min("content").alias("first"))
    # of all places of a kind the most frequent, then the one met first; a number or the empty vote is alone
    slot = F.substring_index("vote", ":", 1)
    best = counted.groupBy("host", "layout", slot.alias("slot")).agg(F.min(F.struct((-F.col("c")).alias("less"), "first", "vote")).alias("b"))
    votes = best.groupBy("host", "layout").agg(F.collect_list(F.struct("b.vote", (-F.col("b.less")).alias("c"))).alias("votes"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for seed, votes in zip(batch.column("seed").to_pylist(), batch.column("votes").to_pylist(), strict=True):
                count = {v["vote"]: v["c"] for v in votes}
                n = count.pop("")
                agreed = {tag: json.loads(place) for tag, _, place in (v.partition(":") for v in sorted(count)) if place}
                same = {int(v) for v, c in count.items() if v.isdecimal() and c >= SAME_SHARE * n}
                made.append(json.dumps(_wrapper(Seed(body_of(seed)), same, n, agreed)))
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("layout"), pa.array(made, pa.string())], names=["host", "layout", "wrapper"])

    return map_arrow(seeds.join(votes, ["host", "layout"]).select("host", "layout", "seed", "votes"), fit, "host string, layout binary, wrapper string", 100)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row (under the given names for id and url)."""
    types = dict(pages.dtypes)
    found = cut(wrappers(pages, url_col, html_col))
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("page"), host_of(url_col).alias("host"))
    rows, wrapper_of = _found_for(own, found, "wrapper")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for page, host, brought in zip(*(batch.column(n).to_pylist() for n in (2, 3, 4)), strict=True):
                root = parse(page or "")
                body = find(root, "body")
                wrapper = None if body is None else wrapper_of(host, _digest(layout(body)), brought)
                if wrapper is not None and wrapper not in known:
                    if len(known) > HELD:
                        known.clear()
                    known[wrapper] = json.loads(wrapper)
                texts.append(text_of(body or root, known.get(wrapper)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return map_arrow(rows.select("id", "url", "page", "host", "brought"), work, f"`{id_col}` {types[id_col]}, `{url_col}` {types[url_col]}, text string, n_chars long")
