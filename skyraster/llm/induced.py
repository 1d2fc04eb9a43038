"""Suffix arrays with longest common prefixes by external induced sorting.

Suffixes are of type L (greater than the next one) or S (less); those of type S after one of type L are the
S* suffixes. The text between two of them is named by rank, the string of names is sorted by
recursion (one that is ``SHORT``, by doubling), and from the order of the S* suffixes two sweeps induce the rest: in ascending order each suffix
puts the one before it, if L, at the head of its character's bucket; in descending order likewise those of type S.

The queue of a sweep is a file in a scratch folder, mapped page by page, and so are all other arrays of more than
``MAPPED`` entries. Tuples (suffix, rank of its source) lie in the queue in buckets by character and each bucket fills in order of the sources, so that the next
stretch in front of the sweep that is filled is the head of the queue, and is taken as one block. A tuple's common
prefix with the one before it in its bucket is one more than the least common prefix between the
two sources, which is looked up when the tuple is taken (minima over stretches of up to 64, and of blocks of 64, are kept).
Prefixes of S* suffixes come from the recursion: those of the names, in characters, and what the first different names share.
Common prefixes are counted up to ``cap``. Only the text is read out of order.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 18
QUEUED, MAPPED = 1 << 16, 1 << 23  # queues, and other arrays, of fewer entries stay in memory
SORTED = 1 << 21  # names sorted at once
SHORT = 1 << 18  # strings of names up to this length are sorted in memory: the recursion ends
SPAN = 6


class Scratch:
    """Arrays in files of a folder that goes when it is left."""

    def __init__(self) -> None:
        self.folder, self.count = tempfile.TemporaryDirectory(prefix="induced-"), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.folder.cleanup()

    def array(self, n: int, kind: str, queue: bool = False) -> np.ndarray:
        if n < (QUEUED if queue else MAPPED):
            return np.zeros(n, kind)
        self.count += 1
        path = os.path.join(self.folder.name, str(self.count))
        out = np.asarray(np.memmap(path, kind, "w+", shape=(n,)))
        os.unlink(path)  # its pages go with the array
        return out


def blocks(n: int, step: int = BLOCK) -> Iterator[tuple[int, int]]:
    for lo in range(0, n, step):
        yield lo, min(n, lo + step)


def coded(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """2 c + 1 for a suffix of type S that begins with c, 2 c for one of type L. Ends are less than all characters."""
    n = len(text)
    out = scratch.array(n, "i4")
    after, type_after = -1, 0  # the character and type to the right
    for hi in range(n, 0, -BLOCK):
        lo = max(0, hi - BLOCK)
        c = text[lo:hi].astype(np.int64)
        step = np.diff(c, append=after)
        where = np.flatnonzero(step)
        following = np.searchsorted(where, np.arange(hi - lo))  # runs of one character have the type of their end
        s = np.append((step[where] > 0).astype(np.int64), type_after)[following]
        out[lo:hi] = 2 * c + s
        after, type_after = int(c[0]), int(s[0])
    return out


def stars(code: np.ndarray) -> np.ndarray:
    """Positions of the S* suffixes."""
    out = [np.zeros(0, np.int64)]
    for lo, hi in blocks(len(code)):
        s = code[max(lo - 1, 0) : hi] & 1
        out.append(np.flatnonzero((s[1:] == 1) & (s[:-1] == 0)) + max(lo - 1, 0) + 1)
    return np.concatenate(out)


def named(code: np.ndarray, at: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, int]:
    """Ranks of the stretches from each S* suffix to the next one's first character, and how many there are."""
    n, m, most = len(code), len(at), int(code.max()) // 2
    bits = (most + 3).bit_length()
    per, pad = 63 // bits, (1 << bits) - 1
    size = np.append(np.diff(at) + 1, n - at[-1] + 1)  # the last one ends in the end of the text

    def word(which: np.ndarray, offset: int) -> np.ndarray:
        out, p, left = np.zeros(len(which), np.int64), at[which] + offset, size[which] - offset
        for k in range(per):
            i = p + k
            c = (code[np.minimum(i, n - 1)] >> 1).astype(np.int64) + 1
            c[i >= n] = 0
            c[left <= k] = pad
            out = out << bits | c
        return out

    first = scratch.array(m, "i8")
    for lo, hi in blocks(m):
        first[lo:hi] = word(np.arange(lo, hi), 0)
    edges = np.unique(np.sort(first[:: max(1, m // 4096)])[:: max(1, min(4096, m) * SORTED // m)][1:]) if m > SORTED else np.zeros(0, np.int64)
    rank, found = scratch.array(m, "i4"), 0
    for b in range(len(edges) + 1):
        which = np.arange(m) if not len(edges) else np.concatenate([lo + np.flatnonzero(np.searchsorted(edges, first[lo:hi], side="right") == b) for lo, hi in blocks(m)])
        key, group, offset = np.asarray(first[which]), np.zeros(len(which), np.int64), 0
        order = np.argsort(key, kind="stable")
        which, key = which[order], key[order]
        todo = np.arange(len(which))  # places in ``which`` whose groups are not told apart yet
        while True:
            offset += per
            new = np.ones(len(todo), bool)
            new[1:] = (key[1:] != key[:-1]) | (group[todo][1:] != group[todo][:-1])
            starts = np.flatnonzero(new)
            group[todo] = np.repeat(todo[starts], np.diff(np.append(starts, len(todo))))
            alone = new & np.append(new[1:], True)
            more = ~alone & np.maximum.reduceat(size[which[todo]] > offset, starts)[np.cumsum(new) - 1] if len(todo) else alone
            todo = todo[more]
            if not len(todo):
                break
            key = word(which[todo], offset)
            order = np.lexsort((key, group[todo]))
            which[todo], key = which[todo][order], key[order]
        new = np.ones(len(which), bool)
        new[1:] = group[1:] != group[:-1]
        rank[which] = found + np.cumsum(new) - 1
        found += int(new.sum())
    return rank, found


class Minima:
    """Least values of ranges of a growing list."""

    def __init__(self, n: int, scratch: Scratch):
        depth = max(1, (n >> SPAN).bit_length())
        self.levels = scratch.array((SPAN + 1) * n, "u2").reshape(SPAN + 1, n)
        self.coarse = scratch.array(depth * ((n >> SPAN) + 1), "u2").reshape(depth, -1)
        self.done = 0

    def append(self, lo: int, values: np.ndarray) -> None:
        hi = lo + len(values)
        _extend(self.levels, lo, hi, values)
        new = hi >> SPAN
        if new > self.done:
            _extend(self.coarse, self.done, new, self.levels[SPAN, (self.done + 1 << SPAN) - 1 : (new << SPAN) : 1 << SPAN])
            self.done = new

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """min of [a, b] for each pair, a <= b."""
        j = np.minimum(_LOG[np.minimum(b - a + 1, len(_LOG) - 1)], SPAN)
        out = np.minimum(self.levels[j, b], self.levels[j, a + (1 << j) - 1])
        rest = np.flatnonzero(b - a >= 2 << SPAN)
        if len(rest):
            first, last = -(-a[rest] >> SPAN), (b[rest] + 1 >> SPAN) - 1
            j = np.frexp((last - first + 1).astype(np.float64))[1] - 1
            out[rest] = np.minimum(out[rest], np.minimum(self.coarse[j, last], self.coarse[j, first + (1 << j) - 1]))
        return out


_LOG = np.frexp(np.maximum(np.arange(2 << SPAN), 1).astype(np.float64))[1].astype(np.int64) - 1


def _extend(levels: np.ndarray, lo: int, hi: int, values: np.ndarray) -> None:
    """Level j: the least of the 2^j values that end in each place."""
    levels[0, lo:hi] = values
    for j in range(1, len(levels)):
        half, below, here = 1 << j - 1, levels[j - 1], levels[j]
        start = max(lo, half)
        if start > lo:
            here[lo : min(start, hi)] = below[lo : min(start, hi)]
        if start < hi:
            np.minimum(below[start:hi], below[start - half : hi - half], out=here[start:hi])


def _run(code: np.ndarray, at: np.ndarray, cap: int) -> np.ndarray:
    """How often each suffix repeats its first character."""
    out, todo, n = np.ones(len(at), np.int64), np.arange(len(at)), len(code)
    first = code[at] >> 1
    for k in range(1, cap):
        i = at[todo] + k
        todo = todo[(i < n) & (code[np.minimum(i, n - 1)] >> 1 == first[todo])]
        if not len(todo):
            break
        out[todo] = k + 1
    return out


def sweep(code: np.ndarray, given: np.ndarray, given_lcp: np.ndarray, down: bool, cap: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, common prefix with the one before) of one sweep, from the given suffixes in the sweep's order.

    A character's bucket holds its induced suffixes (L going up, S going down), then its given ones.
    """
    n, top = len(code), int(code.max()) | 1
    kinds = np.zeros(top + 1, np.int64)
    for lo, hi in blocks(n):
        kinds += np.bincount(code[lo:hi], minlength=top + 1)
    induced = kinds[1::2][::-1] if down else kinds[0::2]
    there = np.zeros(len(induced), np.int64)
    for lo, hi in blocks(len(given)):
        c = code[given[lo:hi]] >> 1
        there += np.bincount((top >> 1) - c if down else c, minlength=len(induced))
    ends = np.cumsum(induced + there)
    head = ends - induced - there  # of the induced parts
    full, begin, total = ends - there, ends - induced - there, int(ends[-1])
    kind = "i4" if n < 2**31 else "i8"
    suffix, source, lcp = scratch.array(total, kind, queue=True), scratch.array(total, kind, queue=True), Minima(total, scratch)
    skipped = np.cumsum(induced)
    for lo, hi in blocks(len(given)):
        c = code[given[lo:hi]] >> 1
        suffix[np.arange(lo, hi) + skipped[(top >> 1) - c if down else c]] = given[lo:hi]
    if not down:  # the end of the text comes first, and induces the last suffix
        c = code[n - 1] >> 1
        suffix[head[c]], source[head[c]] = n - 1, -1
        head[c] += 1
    p = bucket = 0
    while p < total:
        while ends[bucket] <= p:
            bucket = int(np.searchsorted(ends, p, side="right"))
        q, stop, look = min(total, p + BLOCK), bucket, 64
        while stop < len(ends) and begin[stop] < q:  # the next tuple that is not there yet
            part = slice(stop, stop + look)
            open_ = np.flatnonzero(head[part] < full[part])
            if len(open_):
                q = min(q, int(head[stop + open_[0]]))
                break
            stop, look = stop + look, look * 4
        at = np.asarray(suffix[p:q]).astype(np.int64)
        here = code[at]
        own = (here & 1) == (1 if down else 0)
        last = int(np.searchsorted(ends, q - 1, side="right"))
        place = np.arange(p, q)
        home = np.repeat(np.arange(bucket, last + 1), np.diff(np.concatenate([[p], np.minimum(ends[bucket : last + 1], q)])))
        value = np.zeros(q - p, np.uint16)
        behind = np.flatnonzero(own & (place > begin[home]))
        if len(behind):
            g = place[behind]
            value[behind] = np.minimum(lcp.least(source[g - 1].astype(np.int64) + 1, source[g].astype(np.int64)) + np.uint16(1), cap)
        fixed = np.flatnonzero(~own)
        if len(fixed):
            g = place[fixed]
            value[fixed] = given_lcp[g - skipped[home[fixed]]]
            value[fixed[g == begin[home[fixed]]]] = 0
            edge = fixed[(g == full[home[fixed]]) & (g > begin[home[fixed]])]
            if len(edge):
                value[edge] = np.minimum(_run(code, suffix[place[edge] - 1].astype(np.int64), cap), _run(code, at[edge], cap))
        lcp.append(p, value)
        before = np.flatnonzero(at > 0)
        kind = code[at[before] - 1]
        some = (kind & 1) == (1 if down else 0)
        before, kind = before[some], kind[some] >> 1
        if len(before):
            c = (top >> 1) - kind if down else kind
            order = np.argsort(c.astype(np.uint8) if len(ends) <= 256 else c, kind="stable")
            c = c[order]
            new = np.flatnonzero(np.diff(c, prepend=-1))
            many = np.diff(np.append(new, len(c)))
            goal = np.repeat(head[c[new]] - new, many) + np.arange(len(c))
            suffix[goal], source[goal] = at[before[order]] - 1, before[order] + p
            head[c[new]] += many
        p = q
    return suffix, lcp.levels[0]


def _shared(code: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray, cap: int) -> np.ndarray:
    """Common characters of the suffixes at a and b, after ``least`` that were counted before them."""
    out, n = np.minimum(least, cap), len(code)
    todo = np.flatnonzero((out < cap) & (np.maximum(a, b) < n))
    for k in range(cap):
        todo = todo[code[a[todo] + k] >> 1 == code[b[todo] + k] >> 1]
        out[todo] += 1
        todo = todo[(out[todo] < cap) & (np.maximum(a[todo], b[todo]) + k + 1 < n)]
        if not len(todo):
            break
    return out.astype(np.uint16)


def doubled(text: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The same as ``suffixes`` for a short string: ranks of ever longer beginnings, in memory."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    ranks = [rank]
    while int(rank.max()) < n - 1:
        step = 1 << len(ranks) - 1
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(False, key[1:] != key[:-1]))
        ranks.append(rank)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    i, j, shared = order[:-1], order[1:], np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 2, -1, -1):
        a, b = i + shared, j + shared
        alike = (np.maximum(a, b) < n) & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)])
        shared += alike.astype(np.int64) << k
    return order, np.append(0, np.minimum(shared, cap)).astype(np.uint16)


def suffixes(text: np.ndarray, cap: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefix of each suffix with the one before, up to cap < 65,535) of an array of whole numbers >= 0."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint16)
    code = coded(text, scratch)
    at = stars(code)
    m = len(at)
    if m:
        names, count = named(code, at, scratch)
        if count == m:
            order, alike = scratch.array(m, "i4"), np.zeros(m, np.uint16)
            order[names] = np.arange(m)
        else:
            order, alike = doubled(np.asarray(names), cap) if m <= SHORT else suffixes(names, cap, scratch)
        given, given_lcp, stop = scratch.array(m, "i8"), scratch.array(m, "u2"), np.append(at, n)
        for lo, hi in blocks(m):
            j, l = np.asarray(order[lo:hi]).astype(np.int64), np.asarray(alike[lo:hi]).astype(np.int64)
            i = np.concatenate([np.asarray(order[max(lo - 1, 0) : lo]).astype(np.int64), j[:-1]])
            i = i if len(i) == len(j) else np.concatenate([[m], i])  # the first has none before it
            x, y = np.minimum(i + l, m), np.minimum(j + l, m)
            given[lo:hi] = at[j]
            given_lcp[lo:hi] = _shared(code, stop[x], stop[y], stop[y] - at[j], cap)
        if m:
            given_lcp[0] = 0
    else:
        given, given_lcp = np.zeros(0, np.int64), np.zeros(0, np.uint16)
    up, up_lcp = sweep(code, given, given_lcp, False, cap, scratch)
    count, kept, kept_lcp = 0, scratch.array(n, up.dtype.str), scratch.array(n + 1, "u2")
    for hi in range(len(up), 0, -BLOCK):  # those of type L, in descending order
        lo = max(0, hi - BLOCK)
        some = np.flatnonzero(code[up[lo:hi]] & 1 == 0)[::-1] + lo
        kept[count : count + len(some)], kept_lcp[count + 1 : count + 1 + len(some)] = up[some], up_lcp[some]
        count += len(some)
    del up, up_lcp, given, given_lcp
    down, down_lcp = sweep(code, kept[:count], kept_lcp[:count], True, cap, scratch)
    out = scratch.array(n, "u2")
    out[1:] = down_lcp[::-1][:-1]
    return down[::-1], out
