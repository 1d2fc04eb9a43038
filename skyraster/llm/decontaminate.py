"""Benchmark decontamination with an Aho-Corasick automaton over whole words.

Benchmark texts are lower-cased (A-Z only) and cut into words; every run of ``window``
words (or the whole item, if shorter) becomes one pattern. Each distinct benchmark word is
one symbol, so a pattern is a string of ``window`` symbols and a document is scanned once,
word by word, in time linear in its length; a word that no item holds is a symbol that no
pattern holds. Matches are word positions, which map to character offsets of the original.

Cases: null and word-less texts have no words and no hits; word-less items have no windows;
items with equal texts all count; repeated document rows are scored alike, row by row; an
empty table gives no rows (documents) or no hits (benchmark). Extra columns are ignored. Items
without an id hit like others; together they are one item in n_items and none in the digest.

The automaton's size is bounded: items are taken in blocks of at most ``max_block_words``
words, each block is one automaton and one scan, and blocks add to the same hit positions.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyraster.llm.common import ensure, release

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # of the original, so A-Z too
WINDOW = 10
MAX_BLOCK_WORDS = 500_000

# Bytes of words: digits, a-z, everything beyond ASCII; A-Z are folded and the rest become spaces.
_FOLD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)
def words(text: bytes | str | None) -> list[bytes]:
    """Folded words of a text, as UTF-8 bytes."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return raw.translate(_FOLD).split()


def _character(k: int) -> str:
    """The k-th character above the mark for unknown words, leaving out the surrogates."""
    return chr(k + 2 if k + 2 < 0xD800 else k + 2 + 0x800)


class Automaton:
    """Patterns of one block of (item_id, text) rows.

    A word is written as two digits from two separate alphabets, so a node of the automaton
    has few children and no match starts inside a word. Runs of known words that are shorter
    than every pattern are passed over.
    """

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        import ahocorasick

        lists = [(item, words(text)) for item, text in items]
        known = sorted({w for _, found in lists for w in found})
        base = math.isqrt(len(known)) + 1
        self.codes = {w: _character(k // base) + _character(base + k % base) for k, w in enumerate(known)}
        self.ids = sorted({i for i, _ in items}, key=_null_last)
        rank = {x: k for k, x in enumerate(self.ids)}
        owners: dict[str, set[int]] = {}
        for item, found in lists:
            for k in range(max(1, len(found) - window + 1) if found else 0):
                owners.setdefault("".join([self.codes[w] for w in found[k : k + window]]), set()).add(rank[item])
        self.machine = ahocorasick.Automaton()
        for pattern, who in owners.items():
            self.machine.add_word(pattern, (len(pattern) // 2, tuple(who)))
        if owners:
            self.machine.make_automaton()
        self.empty = not owners
        self.runs = re.compile(r"[^\x01]{%d,}" % min(map(len, owners), default=1))

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged [first, last) word ranges inside any window, and the items they belong to."""
        if self.empty or not found:
            return [], set()
        get = self.codes.get
        coded = "".join([get(w, "\x01\x01") for w in found])
        ranges: list[list[int]] = []
        who: set[int] = set()
        for run in self.runs.finditer(coded):
            for last, (size, owners) in self.machine.iter(run[0]):
                end = (run.start() + last + 1) // 2
                who.update(owners)
                _add(ranges, end - size, end)
        return [(a, b) for a, b in ranges], {self.ids[k] for k in who}


def _add(ranges: list[list[int]], a: int, b: int) -> None:
    """Append [a, b) to ranges whose ends never fall, absorbing what it touches."""
    while ranges and ranges[-1][1] >= a:
        last = ranges.pop()
        a, b = min(a, last[0]), max(b, last[1])
    ranges.append([a, b])


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def offsets(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character ranges of the original text for word ranges."""
    at = [m.span() for m in WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def _null_last(item: str | None) -> tuple[bool, str]:
    return item is None, item or ""


def blocks(items: DataFrame, max_words: int) -> Iterator[list[tuple[str | None, str]]]:
    """Benchmark rows in blocks of bounded size; one block at a time is on the driver."""
    block, size = [], 0
    for row in items.toLocalIterator():
        n = len(words(row.text))
        if block and size + n > max_words:
            yield block
            block, size = [], 0
        if n:
            block.append((row.item_id, row.text))
            size += n
    if block:
        yield block


_READY: dict[str, Automaton] = {}
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scanner(shared, token: str, window: int, names: list[str]):
    """A batch function that adds one block's matches to the columns ranges and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _READY:  # one automaton at a time for each worker
            _READY.clear()
            _READY[token] = Automaton(shared.value, window)
        machine = _READY[token]
        for batch in batches:
            n_words, ranges, items, spans = [], [], [], []
            texts = batch.column("text").cast(pa.binary())
            before, had = batch.column("ranges"), batch.column("items")
            for k in range(batch.num_rows):
                raw = texts[k].as_py()
                found = words(raw)
                hit, who = machine.scan(found)
                old = before[k].as_py()
                if old:
                    hit = merge(hit + [(r["a"], r["b"]) for r in old])
                    who |= set(had[k].as_py())
                n_words.append(len(found))
                ranges.append([{"a": a, "b": b} for a, b in hit])
                items.append(sorted(who, key=_null_last))
                spans.append([{"start": a, "end": b} for a, b in (offsets(raw.decode(), hit) if hit else [])])
            new = {
                "n_words": pa.array(n_words, pa.int64()),
                "ranges": pa.array(ranges, batch.schema.field("ranges").type),
                "items": pa.array(items, batch.schema.field("items").type),
                "spans": pa.array(spans, _SPANS),
            }
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names=names)
        release()

    return run


def mark(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW,
         max_block_words: int = MAX_BLOCK_WORDS) -> DataFrame:
    """``keep`` columns of docs, and n_words, ranges (words), items, spans (original characters).

    ``docs`` needs a column ``text``; ``keep`` must not hold the names that are added.
    """
    spark = docs.sparkSession
    items = ensure(benchmark, item_id="string", text="string").where("text is not null")
    out = docs.select(
        *[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])],
        F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<struct<a:long,b:long>>)").alias("ranges"),
        F.expr("filter(array(cast(null as string)), x -> false)").alias("items"),
        F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"),
    )
    ahead = blocks(items, max_block_words)
    block = next(ahead, [])
    while block is not None:
        after = next(ahead, None)
        names = [c for c in out.columns if c != "text" or c in keep or after is not None]
        schema = out.select(*[f"`{c}`" for c in names]).schema
        scan = _scanner(spark.sparkContext.broadcast(block), uuid.uuid4().hex, window, names)
        out = out.mapInArrow(scan, schema)
        block = after
    return out


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    found = mark(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark, ["doc_id"], window)
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_words",
        F.expr("aggregate(ranges, 0L, (s, r) -> s + r.b - r.a)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("ranges") > 0).alias("contaminated"),
        "spans",
    )


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that hold no window, columns unchanged."""
    inner = docs.select(F.struct("*").alias("_row"), F.col("text").cast("string").alias("text"))
    return mark(inner, benchmark, ["_row"], window).where(F.size("ranges") == 0).select("_row.*")
