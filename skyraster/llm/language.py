"""Language identification by a bidirectional gated recurrent network over bytes.

One GRU reads a text's UTF-8 bytes (A-Z folded) from its beginning to its end, one from its end to
its beginning; neither stops at words. At every byte the two states give a probability for each
language, and a document's probability is the mean over all its bytes.

Long texts are cut into chunks of ``CHUNK`` bytes that run side by side, without being read
apart: the state with which a chunk begins is that of the text so far. It is worked out by
running the ``BACK`` bytes before the chunk, and twice as many: if both end in the same
state (to ``SAME``), what lies before has no more say; otherwise twice as many again, as far as the
text goes.

Training is numpy, by backpropagation through time over windows of ``WINDOW`` bytes: cross-entropy at
every byte, Adam. The sample is bounded: about ``TRAIN_WINDOWS`` windows in all, the same number for each
language, up to ``DOC_WINDOWS`` from anywhere in a text, from rows that are not held out and
have a language, chosen by hash of doc_id.

Cases: null texts and texts without a letter are ``und`` with score 0; without any language to
learn, everything is ``und``; very long texts take memory by chunks and time by length;
repeated rows are labelled alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyraster.llm.common import ensure, release
from skyraster.llm.quality_model import held_out

HIDDEN = 16
CHUNK = 8192
BACK = 64
SAME = 1e-3
LANES = 2048
BLOCK = 16  # steps whose probabilities are worked out together
CELLS = 1 << 25  # of a table of logits: lanes * steps * languages
BYTES = 32_000_000
WINDOW = 96
TRAIN_WINDOWS = 40_000
DOC_WINDOWS = 40
EPOCHS = 3
UNKNOWN = "und"
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class Model:
    """Forward and backward GRU, and a softmax over both states at every byte."""

    def __init__(self, languages: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        h = HIDDEN

        def small(*shape: int) -> np.ndarray:
            return rng.normal(0, 0.3, shape).astype(np.float32)

        # x: 256 x 3h input rows (reset, update, new), u: h x 3h; one pair a direction
        self.p = {"xf": small(256, 3 * h), "uf": small(h, 3 * h), "xb": small(256, 3 * h), "ub": small(h, 3 * h),
                  "o": small(2 * h, len(languages)), "c": np.zeros(len(languages), np.float32)}

    @staticmethod
    def _run(data: np.ndarray, x: np.ndarray, u: np.ndarray, tape: list | None) -> np.ndarray:
        """States after each of the columns of data (N x L bytes) in turn: L x N x h."""
        h = u.shape[0]
        state = np.zeros((len(data), h), np.float32)
        out = np.empty((data.shape[1], len(data), h), np.float32)
        for k in range(data.shape[1]):
            gate = x[data[:, k]]
            inner = state @ u
            ru = 0.5 + 0.5 * np.tanh(0.5 * (gate[:, : 2 * h] + inner[:, : 2 * h]))
            reset, update = ru[:, :h], ru[:, h:]
            new = np.tanh(gate[:, 2 * h :] + reset * inner[:, 2 * h :])
            after = new + update * (state - new)
            if tape is not None:
                tape.append((state, inner, reset, update, new))
            state = out[k] = after
        return out

    def positions(self, data: np.ndarray, tapes: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities L x N x languages, states) at every byte of equally long segments."""
        f, b = tapes or (None, None)
        states = np.concatenate([self._run(data, self.p["xf"], self.p["uf"], f), self._run(data[:, ::-1], self.p["xb"], self.p["ub"], b)[::-1]], axis=2)
        z = states @ self.p["o"] + self.p["c"]
        e = np.exp(z - z.max(2, keepdims=True))
        return e / e.sum(2, keepdims=True), states

    @staticmethod
    def _back(data: np.ndarray, u: np.ndarray, tape: list, into: np.ndarray, gx: np.ndarray, gu: np.ndarray) -> None:
        """Adds the gradients of one direction; ``into``: those of its states, in its own order."""
        h = u.shape[0]
        carry = np.zeros_like(into[0])
        for k in range(data.shape[1] - 1, -1, -1):
            state, inner, reset, update, new = tape[k]
            d = into[k] + carry
            dnew = d * (1 - update) * (1 - new * new)
            dupdate = d * (state - new) * update * (1 - update)
            dreset = dnew * inner[:, 2 * h :] * reset * (1 - reset)
            dgate = np.concatenate([dreset, dupdate, dnew], axis=1)
            dinner = np.concatenate([dreset, dupdate, dnew * reset], axis=1)
            np.add.at(gx, data[:, k], dgate)
            gu += state.T @ dinner
            carry = d * update + dinner @ u.T

    def gradients(self, data: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all bytes of equally long segments."""
        tapes: tuple[list, list] = ([], [])
        prob, states = self.positions(data, tapes)
        n = data.shape[0] * data.shape[1]
        dz = prob.copy()
        dz[:, np.arange(len(label)), label] -= 1
        dz /= n
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["o"] = np.tensordot(states, dz, ([0, 1], [0, 1]))
        g["c"] = dz.sum((0, 1))
        ds = dz @ self.p["o"].T
        self._back(data, self.p["uf"], tapes[0], ds[:, :, :HIDDEN], g["xf"], g["uf"])
        self._back(data[:, ::-1], self.p["ub"], tapes[1], ds[::-1, :, HIDDEN:], g["xb"], g["ub"])
        return g

    def fit(self, windows: list[bytes], label: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        size = np.array([len(w) for w in windows])
        step = 0
        for epoch in range(epochs):
            batches = []
            for n in np.unique(size[size > 0]):
                rows = rng.permutation(np.flatnonzero(size == n))
                batches += [rows[a : a + 256] for a in range(0, len(rows), 256)]
            rate = 0.02 / (1 + epoch)
            for k in rng.permutation(len(batches)):
                rows = batches[k]
                data = _FOLD[np.frombuffer(b"".join([windows[r] for r in rows]), np.uint8).reshape(len(rows), -1)]
                g = self.gradients(data, label[rows])
                step += 1
                for name, x in g.items():
                    x = np.clip(x, -1, 1)
                    m[name] = 0.9 * m[name] + 0.1 * x
                    v[name] = 0.999 * v[name] + 0.001 * x * x
                    self.p[name] = (self.p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def _pass(self, way: str, data: np.ndarray, active: list[int], state: np.ndarray, sink: Callable[[int, np.ndarray], None] | None = None) -> np.ndarray:
        """Last states after the steps (rows) of data; at step k the first active[k] lanes run. ``sink``: sees the states of each step."""
        h = HIDDEN
        # exp takes half the time of tanh: a sigmoid is 1 / (1 + exp(-a)), a tanh 2 / (1 + exp(-2a)) - 1; signs and the 2 are in the weights.
        scale = np.array([-1, -1, -2], np.float32)[:, None, None]
        x, u = (np.ascontiguousarray(self.p[w + way].reshape(-1, 3, h).swapaxes(0, 1) * scale) for w in "xu")
        x, rows = x.reshape(-1, h), np.arange(3)[:, None] * 256
        room, width = [np.empty(3 * state.size, np.float32) for _ in range(2)], -1
        with np.errstate(over="ignore"):  # of a gate that is shut
            for k, n in enumerate(active):
                if n != width:
                    width, now = n, state[:n]
                    gate, inner = (r[: 3 * n * h].reshape(3, n, h) for r in room)
                    (reset, update, new), both, recent = gate, gate[:2], inner[2]
                np.take(x, data[k, :n] + rows, axis=0, out=gate, mode="clip")
                np.matmul(now, u, out=inner)
                both += inner[:2]
                np.exp(both, out=both)
                both += 1
                recent /= reset
                new += recent
                np.exp(new, out=new)
                new += 1
                np.divide(2, new, out=new)
                new -= 1
                now -= new
                now /= update
                now += new
                if sink is not None:
                    sink(k, now)
        return state

    def _carried(self, way: str, raw: np.ndarray, at: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """States with which the text between edge and at (in reading order) leaves its reader at ``at``."""
        out = np.zeros((len(at), HIDDEN), np.float32)
        todo, before, back = np.arange(len(at)), None, BACK
        while len(todo):
            have = np.abs(at[todo] - edge[todo])
            n = np.minimum(have, back)
            order = np.argsort(-n, kind="stable")
            state = np.zeros((len(todo), HIDDEN), np.float32)
            for lo in range(0, len(todo), LANES):
                some = order[lo : lo + LANES]
                state[some] = self._from(way, raw, at[todo[some]], n[some])
            done = have <= back
            if before is not None:
                done |= np.abs(state - before).max(1, initial=0) < SAME
            out[todo[done]] = state[done]
            todo, before, back = todo[~done], state[~done], 2 * back
        return out

    def _from(self, way: str, raw: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """States after the n bytes before ``at``, from nothing; n in falling order."""
        sign, active = (1, 0) if way == "f" else (-1, -1), [int(k) for k in (n[:, None] > np.arange(n.max(initial=0))).sum(0)]
        step = np.arange(len(active))[:, None]
        place = at + sign[1] - sign[0] * n + sign[0] * step
        return self._pass(way, self._bytes(raw, place), active, np.zeros((len(at), HIDDEN), np.float32))

    @staticmethod
    def _bytes(raw: np.ndarray, place: np.ndarray) -> np.ndarray:
        return raw[np.clip(place, 0, len(raw) - 1, out=place)]

    def texts(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sum over its bytes of each text's probabilities."""
        n = -(-sizes // CHUNK)
        text = np.repeat(np.arange(len(sizes)), n)
        part = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        first, last = starts[text] + part * CHUNK, np.minimum(starts[text] + (part + 1) * CHUNK, (starts + sizes)[text])
        total = np.zeros((len(sizes), len(self.languages)))
        ahead, behind = np.zeros((len(text), HIDDEN), np.float32), np.zeros((len(text), HIDDEN), np.float32)
        inner, more = np.flatnonzero(part > 0), np.flatnonzero(part < n[text] - 1)
        ahead[inner] = self._carried("f", raw, first[inner], starts[text[inner]])
        behind[more] = self._carried("b", raw, last[more], (starts + sizes)[text[more]])
        order = np.argsort(first - last, kind="stable")  # longest first
        out, ones = self.p["o"], np.ones((len(self.languages),) * 2, np.float32)
        wide = np.abs(out).sum(0).max() + np.abs(self.p["c"]).max() > 80  # else no exp is out of range
        lo = 0
        while lo < len(order):
            steps = int((last - first)[order[lo]])
            some = order[lo : lo + max(16, min(LANES, CELLS // (steps * len(self.languages))))]
            lo += len(some)
            length = (last - first)[some]
            step = np.arange(steps)[:, None]
            # Lanes end together, so that both readers' steps meet without looking places up.
            logits = np.zeros((steps, len(some), len(self.languages)), np.float32)

            def forwards(k: int, state: np.ndarray) -> None:
                np.matmul(state, out[:HIDDEN], out=logits[k, : len(state)])

            data = self._bytes(raw, last[some] - steps + step)
            self._pass("f", data, (length[None, :] >= steps - step).sum(1).tolist(), ahead[some], forwards)
            sums = np.zeros((len(some), len(self.languages)))
            left = (length[None, :] > step).sum(1).tolist()

            def backwards(k: int, state: np.ndarray) -> None:
                at = steps - 1 - k
                logits[at, : len(state)] += state @ out[HIDDEN:]
                if at % BLOCK == 0:  # the steps from here on are done
                    running = left[max(k - BLOCK + 1, 0) : k + 1]
                    z = np.ascontiguousarray(logits[at : at + BLOCK, : running[0]])
                    z += self.p["c"]
                    if wide:
                        z -= z.max(2, keepdims=True)
                    np.exp(z, out=z)
                    z /= z @ ones if len(ones) <= 16 else z.sum(2, keepdims=True)
                    for j, m in enumerate(reversed(running)):
                        z[j, m:] = 0  # shorter texts
                    sums[: running[0]] += z.sum(0)

            data = self._bytes(raw, last[some] - 1 - step)
            self._pass("b", data, left, behind[some], backwards)
            np.add.at(total, text[some], sums)
        return total

    def column(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and probability of every text of an Arrow column."""
        names, scores = [], []
        whole = [t or "" for t in texts.to_pylist()]
        codes = [t.encode("utf-8", "surrogatepass") for t in whole]
        at = 0
        while at < len(whole):
            held, end = 0, at
            while end < len(whole) and (end == at or held + len(codes[end]) <= BYTES):
                held += len(codes[end])
                end += 1
            sizes = np.array([len(c) for c in codes[at:end]], np.int64)
            raw = _FOLD[np.frombuffer(b"".join(codes[at:end]), np.uint8)]
            prob = self.texts(raw, np.cumsum(sizes) - sizes, sizes)
            best = prob.argmax(1)
            share = prob[np.arange(len(prob)), best] / np.maximum(sizes, 1)
            for k, text in enumerate(whole[at:end]):
                known = any(map(str.isalpha, text))
                names.append(self.languages[best[k]] if known else UNKNOWN)
                scores.append(min(max(float(share[k]), 0.0), 1.0) if known else 0.0)
            at = end
        return names, np.array(scores)


def sample(docs: DataFrame, n_windows: int = TRAIN_WINDOWS) -> list:
    """About n_windows rows (lang, window) in all, as many of each language, from texts chosen by hash of doc_id."""
    rows = docs.where(~held_out()).where("lang is not null and length(text) > 0")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # one row for each output of the network
    counts = docs.sparkSession.createDataFrame(counts.collect(), counts.schema)
    n_docs = max(1.0, n_windows / DOC_WINDOWS / max(counts.count(), 1))
    key = F.coalesce("doc_id", F.xxhash64("text"))  # rows without an id are told apart by their text
    u = (F.pmod(F.xxhash64(F.lit("language"), key), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    few = rows.join(F.broadcast(counts), "lang").where(u < n_docs / F.col("n"))
    most = F.least(F.ceil(F.length("text") / WINDOW).cast("int"), F.lit(DOC_WINDOWS))
    room = F.greatest(F.length("text") - WINDOW + 1, F.lit(1))
    start = F.pmod(F.xxhash64(key, F.col("k")), room.cast("long")).cast("int") + 1
    windows = few.select("lang", "doc_id", "text", F.explode(F.sequence(F.lit(1), most)).alias("k")).select("lang", "doc_id", "k", F.substr("text", start, F.lit(WINDOW)).alias("text"))
    return windows.orderBy("lang", "doc_id", "k", "text").collect()


def train(rows: list, epochs: int = EPOCHS) -> Model | None:
    """A model of rows (lang, text), each cut to WINDOW bytes."""
    languages = sorted({r.lang for r in rows})
    if not languages:
        return None
    number = {x: k for k, x in enumerate(languages)}
    windows = [r.text.encode("utf-8", "surrogatepass")[:WINDOW] for r in rows]
    return Model(languages).fit(windows, np.array([number[r.lang] for r in rows]), epochs)


def identify(docs: DataFrame, n_windows: int = TRAIN_WINDOWS) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    docs = ensure(docs, doc_id="long", text="string", lang="string")
    model = docs.sparkSession.sparkContext.broadcast(train(sample(docs, n_windows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model.value is None:
                names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                names, scores = model.value.column(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score"])
        release()

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
