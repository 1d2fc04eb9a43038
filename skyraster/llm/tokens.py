"""Exact, memoised use of a public tokenizer file on whole texts.

A tokenizer that never merges across a space gives the same ids for a text as for its
space-separated pieces one after the other, so each distinct piece is encoded once by the
library and then looked up. The word vocabulary folds case and parts a letter from the mark
after it, so an unknown piece of Latin-1 letters and at most one mark is a folded word, which
goes to the library's model alone, and that mark; all others go through the whole tokenizer.
The memo is bounded: when full, the older half goes.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from skyraster.llm.common import release

MEMO = 600_000
CHUNK_CHARS = 1_000_000
ROWS = 4_000
STRIP = 500_000
MARKS = ".,;:!?"


class PieceEncoder:
    """Ids of whole texts as little-endian bytes, two each (four for large vocabularies)."""

    def __init__(self, path: str, lead: bool = False, memo: int = MEMO):
        """``lead``: pieces keep the one space before them (byte-level vocabularies)."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.lead, self.limit = lead, memo
        self.kind = "H" if self.library.get_vocab_size() <= 0x10000 else "I"
        self.width = array(self.kind).itemsize
        self.new: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        if not lead:
            self.model = self.library.model
            shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.letters = {c: shown.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x100) if chr(c).isalpha()}

    def rest(self) -> None:
        """Give memory back at the end of a task: the worker may idle beside other work."""
        self.old = {}
        release()

    def pieces(self, text: str) -> list[str]:
        if not self.lead:
            return text.replace("\n", " ").split(" ")
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def learn(self, wanted: set[str]) -> None:
        """Bring every wanted piece into the newer half of the memo."""
        missing = wanted - self.new.keys()
        if len(self.new) + len(missing) > self.limit:
            self.old, self.new = self.new, {"": b""}
            missing = wanted - {""}
        if self.old:
            known = missing & self.old.keys()
            for x in known:
                self.new[x] = self.old[x]
            missing -= known
        if not missing:
            return
        if self.lead:
            self._encode(list(missing))
            return
        have, slow, letters, kind = self.new, [], self.letters, self.kind
        tokenize, marks = self.model.tokenize, {m: self._mark(m) for m in MARKS}
        for x in missing:
            last = x[-1]
            core, mark = (x[:-1], marks[last]) if last in marks and x[-2:-1].isalpha() else (x, b"")
            plain = core.isascii()
            # A folded word of Latin-1 letters is one pre-token: straight to the library's model. Of others the memo says nothing
            # about what they are before a mark.
            if not core.isalpha() or not (plain or max(core) <= "\xff"):
                slow.append(x)
                continue
            if plain:
                core = core.lower()
            known = have.get(core)
            if known is None:
                word = core if plain else core.lower().translate(letters)
                known = have[core] = array(kind, [t.id for t in tokenize(word)]).tobytes()
            have[x] = known + mark
        if slow:
            self._encode(slow)

    def _mark(self, mark: str) -> bytes:
        if mark not in self.new:
            self._encode([mark])
        return self.new[mark]

    def _encode(self, order: list[str]) -> None:
        """Remember the ids of pieces of any kind, by the whole tokenizer."""
        for x, e in zip(order, self.library.encode_batch_fast(order, add_special_tokens=False), strict=True):
            self.new[x] = array(self.kind, e.ids).tobytes()

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """One bytes object for each text, in order."""
        waiting: list[list[str]] = []
        held = 0
        for text in texts:
            waiting.append(self.pieces(text))
            held += len(text)
            if held >= CHUNK_CHARS:
                yield from self._flush(waiting)
                waiting, held = [], 0
        yield from self._flush(waiting)

    def _flush(self, waiting: list[list[str]]) -> Iterator[bytes]:
        if waiting:
            self.learn(set().union(*waiting))
            get = self.new.__getitem__
            for pieces in waiting:
                yield b"".join(map(get, pieces))

    def _parts(self, texts: pa.Array) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
        """For runs of rows: ids of the distinct pieces, which piece stands where, ends of the rows."""
        for start in range(0, len(texts), ROWS):
            part = pc.fill_null(texts.slice(start, ROWS), "")
            lists = pc.split_pattern(pc.replace_substring(part, "\n", " "), " ")
            coded = lists.flatten().dictionary_encode()
            pieces = coded.dictionary.to_pylist()
            ids = list(map(self.new.get, pieces))
            missing = [k for k, x in enumerate(ids) if x is None]
            if missing:
                before = self.new
                self.learn({pieces[k] for k in missing})
                for k in missing:
                    ids[k] = self.new[pieces[k]]
                if self.new is not before:  # what is in use stays in the newer half
                    self.new.update(zip(pieces, ids, strict=True))
            yield ids, coded.indices.to_numpy(), lists.value_lengths().to_numpy().cumsum()

    def count_column(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text of an Arrow column."""
        out = [np.zeros(0, np.int64)]
        for ids, index, ends in self._parts(texts):
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
            total = np.concatenate([[0], np.cumsum(size[index])])
            out.append(np.diff(total[ends], prepend=0))
        return np.concatenate(out)

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """The same as ``encode`` for a whole Arrow column: distinct pieces are told apart by
        Arrow, ids are put together by numpy, and Python sees each distinct piece once."""
        for ids, index, ends in self._parts(texts):
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
            first = np.cumsum(size) - size
            flat = np.frombuffer(b"".join(ids), f"u{self.width}")
            at = 0
            for lo, hi in _strips(ends):
                end = int(ends[hi - 1])
                used = index[at:end]
                n = size[used]
                stop = np.cumsum(n)
                out = flat[np.repeat(first[used] - (stop - n), n) + np.arange(int(stop[-1]) if len(stop) else 0)].tobytes()
                bounds = [0, *(np.concatenate([[0], stop])[ends[lo:hi] - at] * self.width).tolist()]
                for a, b in zip(bounds, bounds[1:], strict=False):
                    yield out[a:b]
                at = end


def _strips(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about STRIP pieces each."""
    lo = 0
    while lo < len(ends):
        base = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + STRIP, side="right")))
        yield lo, hi
        lo = hi


_READY: dict[tuple, PieceEncoder] = {}


def encoder(path: str, lead: bool = False) -> PieceEncoder:
    """This worker's encoder for a file."""
    if (path, lead) not in _READY:
        _READY[path, lead] = PieceEncoder(path, lead)
    return _READY[path, lead]
