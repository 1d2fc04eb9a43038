"""Main text of web pages through inferred wrappers.

A wrapper is a union-free regular expression over a host's pages: nested tags, parts that may be
absent (?), groups that repeat (+), and text slots. A page is read as a stream of tags and texts,
elements without text are left out, and neighbouring equal runs (up to ``PERIOD`` tags) fold into
repeated groups; what remains is the page's expression. A host's different expressions are aligned
one after the other, list by list: a longest common subsequence of equal shapes (a tag and the
tags in it), then of like ones (a tag, with or without blocks in it) in the gaps, is merged,
everything else becomes optional, and new neighbouring equal runs fold. Texts keep counts: pages,
characters, link characters, and the least and greatest checksum, which are equal for a constant.

What is main text follows from these counts:

* A text that half of a host's pages or more (two at least) hold alike, while others vary, is
  template.
* The mass of a part is its varying text outside links. From the root one goes down into the
  part with half the mass or more, as long as it neither repeats nor holds plain text only; a part
  with a varying h1 needs only 1 / ``ASIDE`` of the greatest mass beside it. Where this ends, after one step
  up if a heading stands before it there, is the container.
* Main are the container's texts that are neither template nor mostly links.

Names only break ties: parts whose masses are within ``TIE`` of each other go by what their tags
and classes say; of nested containers one that is named as such is taken, with its constant texts;
and a part named as an aside (comments, advert, form and the like) counts for nothing, whatever its
weight, where the container is named as the article, or a part beside it is or has a heading of varying words (but for an aside with a varying h1 of its own); elsewhere it has to
outweigh what stands beside it ``ASIDE`` times. One page alone has no template; there mass is all text
outside links.

Inference never brings a host's pages together. Tasks count expressions; a host's different ones
are dealt to buckets of about ``FAN`` by hash and merged there in their own order, buckets merge
in the same way, so no wrapper depends on the partitioning. Parts on fewer than 1 in ``RARE``
pages are dropped from wrappers, which bounds them. Each expression is matched with its host's
wrapper by the same alignment, once; parts that the wrapper lacks are main if they stand
in its container, and pages without that container are wrappers of their own.

Cases: null, empty and tagless pages (tagless text is one block); a page without url belongs to
the host ''; unclosed and misnested tags close where the next block begins; elements nest to any
depth; repeated rows are extracted alike; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
import sys
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyraster.llm.common import cut, ensure, shared_dir

PERIOD = 4
TIE, ASIDE = 4, 20
FAN = 1000
HELD = 8_000_000
RARE = 1000
MAX_BROADCAST_CHARS = 32_000_000
MEMO = 5000

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
CLOSES = {  # a start tag ends an open element of these names that is nearer than the next container
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
CONTAINERS = set("ul ol dl table tbody thead tfoot div section article main body aside nav header footer form blockquote".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
NO_TEXT = set("head select button svg object audio video canvas map template noscript datalist".split())  # of no reading text, whatever they hold
HEAD = set("title base link meta style script noscript template".split())
ASIDES = set(  # tags and class words; they break ties
    "nav footer aside form menu dialog header hidden ad ads advert adverts advertisement sponsor sponsored promo banner sidebar navbar breadcrumb breadcrumbs comment comments"
    " reply replies respond share social related newsletter subscribe signup login cookie cookies consent notice popup modal overlay widget pagination".split()
)
MAIN_NAMES = {"article": 3, "main": 2, "articlebody": 1, "post": 1, "entry": 1, "story": 1, "content": 1}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|xmp|iframe|noembed|noframes)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Node:
    """A part of an expression: a text (key "#"), a repeated group (key "()") or an element.

    n: pages that hold it; chars, links, low, high: a text's counts and checksums; blocks: the
    numbers of a page's blocks that stand here.
    """

    __slots__ = ("key", "kids", "optional", "repeated", "shape", "n", "chars", "links", "low", "high", "blocks", "mass", "first", "told", "inside", "main")

    def __init__(self, key: str, kids: list[Node] | None = None):
        self.key, self.kids = key, kids or []
        self.optional = self.repeated = False
        self.n, self.chars, self.links, self.low, self.high = 1, 0, 0, 0, 0
        self.blocks: list[int] = []
        self.mass, self.first, self.told, self.inside, self.main = 0, False, False, False, False
        self.shape = key

    def settle(self) -> Node:
        """Set the shape once the children are known."""
        if self.key == "()":
            self.shape = "(" + " ".join([k.shape for k in self.kids]) + ")"
        elif self.key != "#":
            self.shape = self.key + "[" + ",".join(sorted({p for k in self.kids for p in _parts(k)})) + "]"
        return self

    @property
    def like(self) -> str:
        """The shape as far as pages of one template may be expected to share it."""
        if self.key in ("#", "()"):
            return self.shape
        return self.key + (":blocks" if any(k.key != "#" for k in self.kids) else ":text")


def _parts(node: Node) -> list[str]:
    """Keys that a child adds to its parent's shape; a group adds its members'."""
    if node.key != "()":
        return [node.key]
    out, todo = [], list(node.kids)
    while todo:
        k = todo.pop()
        if k.key == "()":
            todo += k.kids
        else:
            out.append(k.key)
    return out


# --- pages as expressions -------------------------------------------------------------------


def _key(tag: str, attributes: str) -> str:
    """The tag with its telling attribute words, digits left out."""
    tag = re.sub(r"[^a-z0-9:_-]", "", tag)
    if not attributes.strip():
        return tag
    said = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            said.append("hidden")
        elif name in ("class", "id", "role", "itemprop"):
            said += [w for w in re.split(r"[^a-z]+", value) if w]
    return ".".join([tag, *sorted(set(said))])


def parse(page: str) -> tuple[Node, list[tuple[str, int]]]:
    """(expression, blocks of (text, link characters)) of a page."""
    root = Node("html")
    stack: list[tuple[Node, str]] = [(root, "html")]
    blocks: list[tuple[str, int]] = []
    buffer: list[str] = []
    state = [0, 0, 0]  # open links, characters in them, open elements of no text

    def flush() -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text and not state[2]:
                leaf = Node("#")
                leaf.blocks = [len(blocks)]
                stack[-1][0].kids.append(leaf)
                blocks.append((text, min(state[1], len(text))))
            buffer.clear()
            state[1] = 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            node, tag = stack.pop()
            state[2] -= tag in NO_TEXT
            if node.kids:  # elements without text are left out
                node.kids = fold(node.kids)
                stack[-1][0].kids.append(node.settle())

    def add(text: str) -> None:
        buffer.append(text)
        if state[0]:
            state[1] += len(text)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        end, tag, attributes = m[2], m[3], m[4]
        if tag is None:
            end, tag, attributes = m[5], m[6], m[7]
        if tag is None:
            continue  # comments, declarations, and elements whose content is no text
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                add(" ")
            elif tag == "a":
                state[0] = 0 if end else 1
            continue
        flush()
        if len(stack) > 1 and stack[1][1] == "head" and tag not in HEAD:
            close(1)  # whatever else begins, the head is over
        if tag in ("html", "body"):
            continue
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][1] == tag:
                    close(k)
                    break
            continue
        if stack[-1][1] == "p":
            close(len(stack) - 1)  # any block ends a paragraph
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][1] in CLOSES[tag]:
                    close(k)
                    break
                if stack[k][1] in CONTAINERS:
                    break
        if tag not in VOID and not attributes.endswith("/"):
            stack.append((Node(_key(tag, attributes)), tag))
            state[2] += tag in NO_TEXT
    if at < len(page):
        add(page[at:])
    flush()
    close(1)
    root.kids = fold(root.kids)
    root.settle()
    for leaf in leaves(root):
        text = "\n".join([blocks[k][0] for k in leaf.blocks])
        leaf.chars, leaf.links = sum([len(blocks[k][0]) for k in leaf.blocks]), sum([blocks[k][1] for k in leaf.blocks])
        leaf.low = leaf.high = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    return root, blocks


def nodes(root: Node) -> Iterator[Node]:
    """All parts, parents first, in page order."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += reversed(node.kids)


def leaves(root: Node) -> Iterator[Node]:
    return (x for x in nodes(root) if x.key == "#")


def stream(root: Node) -> str:
    """The expression as text: ``<key`` opens, ``>`` closes, ``#`` is a text; ? and + as in patterns."""
    out: list[str] = []
    todo: list[Node | None] = [root]
    while todo:
        node = todo.pop()
        if node is None:
            out.append(">")
            continue
        out.append(("#" if node.key == "#" else "<" + node.key) + "?" * node.optional + "+" * node.repeated)
        if node.key != "#":
            todo += [None, *reversed(node.kids)]
    return " ".join(out)


def counts(root: Node) -> bytes:
    return np.array([v for x in nodes(root) for v in (x.n, x.chars, x.links, x.low, x.high)], np.int64).tobytes()


def build(text: str, numbers: np.ndarray) -> Node:
    """The inverse of ``stream`` and ``counts``."""
    stack = [Node("")]
    for token in text.split(" "):
        if token == ">":
            stack.pop().settle()
            continue
        name = token.rstrip("?+")
        node = Node("#" if name == "#" else name[1:])
        node.optional, node.repeated = "?" in token[len(name) :], "+" in token[len(name) :]
        stack[-1].kids.append(node)
        if name != "#":
            stack.append(node)
    root = stack[0].kids[0]
    for node, row in zip(nodes(root), numbers.reshape(-1, 5).tolist(), strict=True):
        node.n, node.chars, node.links, node.low, node.high = row
    return root


# --- alignment ------------------------------------------------------------------------------


def fold(children: list[Node]) -> list[Node]:
    """Neighbouring equal runs become repeated groups (a run of one part: that part, repeated)."""
    out: list[Node] = []
    for child in children:
        out.append(child)
        again = True
        while again:
            again = False
            for n in range(1, PERIOD + 1):
                names = [x.shape for x in out[-n:]]
                if n == 1 and len(out) > 1 and out[-2].shape == names[0]:
                    last = out.pop()
                    out[-1] = merge(out[-1], last, together=True)
                    out[-1].repeated = again = True
                elif n > 1 and len(out) > n and out[-n - 1].key == "()" and [x.shape for x in out[-n - 1].kids] == names:
                    run = out[-n:]
                    del out[-n:]
                    group = out[-1]
                    group.kids = [merge(a, b, together=True) for a, b in zip(group.kids, run, strict=True)]
                    group.settle()
                    again = True
                elif n > 1 and len(out) >= 2 * n and names == [x.shape for x in out[-2 * n : -n]]:
                    run, before = out[-n:], out[-2 * n : -n]
                    del out[-2 * n :]
                    group = Node("()", [merge(a, b, together=True) for a, b in zip(before, run, strict=True)])
                    group.repeated, group.n = True, group.kids[0].n
                    out.append(group.settle())
                    again = True
                if again:
                    break
    return out


def merge(a: Node, b: Node, together: bool = False) -> Node:
    """What accepts all that two like parts accept, in place of the first. ``together``: both stand on the same pages."""
    a.optional, a.repeated = a.optional or b.optional, a.repeated or b.repeated
    a.n = max(a.n, b.n) if together else a.n + b.n
    if a.key == "#":
        a.chars, a.links = a.chars + b.chars, a.links + b.links
        a.low, a.high = min(a.low, b.low), max(a.high, b.high)
        a.blocks += b.blocks
        return a
    kids = []
    for x, y in align(a.kids, b.kids):
        if x is not None and y is not None:
            kids.append(merge(x, y, together))
        else:
            one = x or y
            one.optional = True
            kids.append(one)
    a.kids = fold(kids)
    return a.settle()


def common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, by bit vectors over ``y``.

    Row i of the vectors has a 0 where taking in y[j] lengthens the common subsequence of
    x[:i + 1] and y[:j + 1]. Of the rows only every so many are kept, the others come again.
    """
    head = 0
    while head < len(x) and head < len(y) and x[head] == y[head]:
        head += 1
    pairs = [(k, k) for k in range(head)]
    x, y = x[head:], y[head:]
    if not x or not y:
        return pairs
    places: dict[str, int] = {}
    for j, name in enumerate(y):
        places[name] = places.get(name, 0) | 1 << j
    full = (1 << len(y)) - 1

    def rows(v: int, lo: int, hi: int) -> list[int]:
        out = []
        for name in x[lo:hi]:
            u = v & places.get(name, 0)
            v = ((v + u) | (v - u)) & full
            out.append(v)
        return out

    step = int(len(x) ** 0.5) + 1
    kept, v = [full], full
    for lo in range(0, len(x), step):
        v = rows(v, lo, lo + step)[-1]
        kept.append(v)
    found, i, j = [], len(x), len(y)
    for part in range(len(kept) - 2, -1, -1):
        lo = part * step
        some = rows(kept[part], lo, lo + step)
        while i > lo and j > 0:
            if some[i - 1 - lo] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            above = some[i - 1 - lo] if i > lo else kept[part]
            if above >> (j - 1) & 1:
                j -= 1
                found.append((head + i, head + j))
    return pairs + found[::-1]


def align(x: list[Node], y: list[Node]) -> list[tuple[Node | None, Node | None]]:
    """Both lists in one order: equal shapes are pairs, then like ones in the gaps between those."""
    out: list[tuple[Node | None, Node | None]] = []
    i = j = 0
    for a, b in [*common([w.shape for w in x], [w.shape for w in y]), (len(x), len(y))]:
        left, right = x[i:a], y[j:b]
        p = q = 0
        for c, d in [*common([w.like for w in left], [w.like for w in right]), (len(left), len(right))]:
            out += [(w, None) for w in left[p:c]] + [(None, w) for w in right[q:d]]
            if c < len(left):
                out.append((left[c], right[d]))
            p, q = c + 1, d + 1
        if a < len(x):
            out.append((x[a], y[b]))
        i, j = a + 1, b + 1
    return out


def prune(root: Node) -> Node:
    """Without the parts that fewer than 1 in RARE pages hold."""
    for node in [x for x in nodes(root) if x.kids]:
        node.kids = [k for k in node.kids if k.n * RARE >= root.n]
    for node in reversed(list(nodes(root))):
        node.settle()
    return root


# --- labels ---------------------------------------------------------------------------------


def _aside(key: str, in_article: bool) -> bool:
    tag, *said = key.split(".")
    return (tag in ASIDES and not (tag == "header" and in_article)) or not ASIDES.isdisjoint(said)


def _rank(key: str) -> int:
    """How surely a name is that of the main text; -1: an aside."""
    return -1 if _aside(key, False) else max([MAIN_NAMES.get(w, 0) for w in key.split(".")])


def _leads(node: Node) -> bool:
    """Whether a part holds a page's first heading, in words that vary."""
    return node.first and not node.repeated


def _told(node: Node) -> bool:
    """Whether a part says itself that it is the article: by any heading, or a name of the main text."""
    return node.told and not node.repeated


def label(root: Node) -> Node:
    """Marks the container's parts (inside) and the main texts (main), in place."""
    every = list(nodes(root))
    varies = any(x.low != x.high for x in every if x.key == "#")

    def template(leaf: Node) -> bool:
        return varies and leaf.low == leaf.high and leaf.n >= 2 and 2 * leaf.n >= root.n

    for x in reversed(every):
        x.inside = x.main = False
        if x.key == "#":
            x.mass = 0 if template(x) or 2 * x.links > x.chars else x.chars - x.links
            x.first = x.told = False
        else:
            x.mass = sum([k.mass for k in x.kids])
            tag, once, plain = x.key.split(".")[0], x.mass > 0 and not x.repeated, [k for k in x.kids if not _aside(k.key, True)]
            x.first = tag == "h1" and once or any([k.first for k in x.kids])
            x.told = once and (tag in HEADINGS or _rank(x.key) > 0) or any([k.told for k in plain])
    chain = [root]
    while True:
        here = chain[-1]
        plain = sum([k.mass for k in here.kids if not _aside(k.key, False)])
        beside = [k for k in here.kids if not _aside(k.key, False)]
        led, told = any(map(_leads, beside)), any(map(_told, beside))
        kids = [k for k in here.kids if not _aside(k.key, False) or (k.mass > ASIDE * plain and not led and (_leads(k) or not told))]
        boxes = [k for k in kids if k.mass and not k.repeated and k.like.endswith(":blocks")]
        if not boxes:
            break
        most, total = max([k.mass for k in kids]), sum([k.mass for k in kids])
        rivals = [k for k in boxes if (ASIDE if _leads(k) else TIE) * k.mass >= most]
        if not rivals:
            break
        best = max(rivals, key=lambda k: (_rank(k.key), _leads(k), k.mass))
        says = (_rank(best.key), _leads(best))
        if 2 * best.mass < total and (max(says) < 1 or any(k is not best and (_rank(k.key), _leads(k)) == says for k in rivals)):
            break
        chain.append(best)
    ranks = [_rank(x.key) for x in chain]
    if max(ranks) > 0:  # a name for where in the chain the article begins
        chain = chain[: ranks.index(max(ranks)) + 1]
    elif len(chain) > 1 and any(k.key.split(".")[0] in HEADINGS and k.mass for k in chain[-2].kids[: chain[-2].kids.index(chain[-1])]):
        chain.pop()
    top, named = chain[-1], max(ranks) > 0
    todo = [top]
    while todo:
        x = todo.pop()
        x.inside = True
        if x.key == "#":
            x.main = named or not (template(x) or 2 * x.links > x.chars)
        beside = [k for k in x.kids if not _aside(k.key, named)]
        led, told = any(map(_leads, beside)), named or any(map(_told, beside))
        for k in x.kids:
            if k.key == "#" or not (_aside(k.key, named) and (led or (told and not _leads(k)) or k.mass <= ASIDE * (top.mass - k.mass))):
                todo.append(k)
    return root


def chosen(page: Node, wrapper: Node) -> tuple[list[bool], bool]:
    """For each text of a page's expression whether it is main; and whether the wrapper told so."""
    main: dict[int, bool] = {}
    held = False
    todo: list[tuple[Node, Node]] = [(page, wrapper)]
    while todo:
        x, y = todo.pop()
        if x.key == "#":
            main[id(x)] = y.main
            held = held or y.inside
            continue
        pairs, left = _matched(x.kids, y.kids)
        todo += pairs
        for k in left:  # the wrapper has no such part
            for leaf in _own(k):
                main[id(leaf)] = y.inside and 2 * leaf.links <= leaf.chars
    if not held and not any(main.values()):  # a page without its host's container stands for itself
        label(page)
        return [x.main for x in leaves(page)], False
    return [main.get(id(x), False) for x in leaves(page)], True


def _own(node: Node) -> Iterator[Node]:
    """Texts of a part, without those in asides."""
    todo = [node]
    while todo:
        x = todo.pop()
        if x.key == "#":
            yield x
        elif not _aside(x.key, True):
            todo += x.kids


def _matched(x: list[Node], y: list[Node]) -> tuple[list[tuple[Node, Node]], list[Node]]:
    """Pairs by alignment, then for each part left over its next like within the list and its groups; and what has none."""
    pairs = align(x, y)
    out = [(a, b) for a, b in pairs if a is not None and b is not None]
    if len(out) == len(x):
        return out, []
    flat: list[Node] = []
    todo = list(reversed(y))
    while todo:
        w = todo.pop()
        flat.append(w)
        if w.key == "()":
            todo += reversed(w.kids)
    where = {id(w): k for k, w in enumerate(flat)}
    places: dict[str, list[int]] = {}
    for k, w in enumerate(flat):
        places.setdefault(w.shape, []).append(k)
        if w.like != w.shape:
            places.setdefault(w.like, []).append(k)
    left, at = [], 0
    todo2 = [(a, b) for a, b in reversed(pairs) if a is not None]
    while todo2:
        a, b = todo2.pop()
        if b is not None:
            at = where[id(b)]
            continue
        found = places.get(a.shape) or places.get(a.like)
        if found:
            at = next((k for k in found if k >= at), found[0])
            out.append((a, flat[at]))
        elif a.key == "()":
            todo2 += [(k, None) for k in reversed(a.kids)]
        else:
            left.append(a)
    return out, left


# --- the operator ---------------------------------------------------------------------------

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_ROWS = "host string, bucket long, expression string, numbers binary"


def _deep() -> None:
    """Parts nest as deep as the pages do; calls among Python functions take no C stack."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))


def _batch(rows: list[tuple[str, int, str, bytes]]) -> pa.RecordBatch:
    host, bucket, expression, numbers = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(bucket, pa.int64()), pa.array(expression, pa.string()), pa.array(numbers, pa.binary())],
                                      names=["host", "bucket", "expression", "numbers"])


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counts of equal expressions together: pages, characters and links add up."""
    a, b = a.reshape(-1, 5), b.reshape(-1, 5)
    return np.column_stack([a[:, :3] + b[:, :3], np.minimum(a[:, 3], b[:, 3]), np.maximum(a[:, 4], b[:, 4])]).reshape(-1)


def _expressions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different expressions of a task's pages, with counts; those seen go on when they fill HELD characters."""
    _deep()
    seen: dict[tuple[str, str], np.ndarray] = {}
    held = 0

    def sums() -> pa.RecordBatch:
        return _batch([(host, 0, text, numbers.tobytes()) for (host, text), numbers in seen.items()])

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if page:
                root, blocks = parse(page)
                if blocks:
                    key, numbers = (host, stream(root)), np.frombuffer(counts(root), np.int64)
                    if key in seen:
                        seen[key] = _sum(seen[key], numbers)
                    else:
                        seen[key] = numbers
                        held += len(key[1]) + numbers.nbytes
        if held > HELD:
            yield sums()
            seen, held = {}, 0
    if seen:
        yield sums()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each (host, bucket) from rows in order of host, bucket and expression."""
    _deep()
    at: tuple[str, int] | None = None
    wrapper: Node | None = None
    text, numbers = "", np.zeros(0, np.int64)

    def take() -> None:
        nonlocal wrapper, text
        if text:
            one = build(text, numbers)
            wrapper = one if wrapper is None else merge(wrapper, one)
            text = ""

    for batch in batches:
        for row in batch.to_pylist():
            here, more = (row["host"], row["bucket"]), np.frombuffer(row["numbers"], np.int64)
            if here != at or row["expression"] != text:
                take()
                if here != at:
                    if at is not None and wrapper is not None:
                        prune(wrapper)
                        yield _batch([(*at, stream(wrapper), counts(wrapper))])
                    at, wrapper = here, None
                text, numbers = row["expression"], more
            else:
                numbers = _sum(numbers, more)
    take()
    if at is not None and wrapper is not None:
        prune(wrapper)
        yield _batch([(*at, stream(wrapper), counts(wrapper))])


def wrappers(pages: DataFrame, folder: str) -> DataFrame:
    """(host, bucket, expression, numbers) of pages(host, html): the wrapper of every host."""
    rows = cut(pages.select("host", "html").mapInArrow(_expressions, _ROWS), f"{folder}/expressions")
    sizes = rows.groupBy("host").agg(F.count_distinct(F.xxhash64("expression")).alias("n"))
    rows = rows.join(sizes, "host").withColumn("bucket", F.pmod(F.xxhash64("expression"), F.ceil(F.col("n") / FAN)))
    level = 0
    while True:
        order = ["host", "bucket", "expression"]
        dealt = rows.select(*order, "numbers").repartition("host", "bucket").sortWithinPartitions(*order)
        rows = cut(dealt.mapInArrow(_merged, _ROWS), f"{folder}/wrappers-{level}")
        if rows.groupBy("host").count().where("count > 1").isEmpty():
            return rows
        rows, level = rows.withColumn("bucket", F.floor(F.col("bucket") / FAN)), level + 1


class Extractor:
    """Applies wrappers, each read and labelled once, and each expression matched once."""

    def __init__(self) -> None:
        self.ready: dict[str, Node] = {}
        self.known: dict[tuple[str, str], list[bool]] = {}

    def text(self, host: str, page: str | None, wrapper: tuple[str, bytes] | None) -> str:
        if not page:
            return ""
        root, blocks = parse(page)
        if not blocks:
            return ""
        key = (host, stream(root))
        if wrapper is None:  # without inference a page is its own wrapper
            main = [x.main for x in leaves(label(root))]
        elif key in self.known:
            main = self.known[key]
        else:
            if len(self.ready) > MEMO:
                self.ready.clear()
            if len(self.known) > MEMO:
                self.known.clear()
            if host not in self.ready:
                self.ready[host] = label(build(wrapper[0], np.frombuffer(wrapper[1], np.int64)))
            main, told = chosen(root, self.ready[host])
            if told:  # of equal expressions all
                self.known[key] = main
        picked = sorted([b for x, m in zip(leaves(root), main, strict=True) if m for b in x.blocks])
        return " ".join([blocks[k][0] for k in picked])


_READY: dict[str, Extractor] = {}


def extract(pages: DataFrame, infer: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of every page. ``infer=False``: every page by itself, to compare with."""
    spark = pages.sparkSession
    pages = ensure(pages, page_id="long", url="string", html="string")
    pages = pages.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)))
    shared = None
    if infer:
        found = wrappers(pages, shared_dir(spark)).select("host", "expression", "numbers")
        size = found.agg(F.sum(F.length("expression") + F.length("numbers") + F.length("host"))).first()[0] or 0
        if size <= MAX_BROADCAST_CHARS:
            shared = spark.sparkContext.broadcast({r.host: (r.expression, bytes(r.numbers)) for r in found.collect()})
        else:
            pages = pages.join(found, "host", "left")
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _deep()
        if token not in _READY:
            _READY.clear()
            _READY[token] = Extractor()
        tool = _READY[token]
        for batch in batches:
            hosts = batch.column("host").to_pylist()
            if shared is not None:
                known = [shared.value.get(h) for h in hosts]
            elif infer:
                known = [None if e is None else (e, n) for e, n in zip(batch.column("expression").to_pylist(), batch.column("numbers").to_pylist(), strict=True)]
            else:
                known = [None] * len(hosts)
            texts = [tool.text(h, p, w) for h, p, w in zip(hosts, batch.column("html").to_pylist(), known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
