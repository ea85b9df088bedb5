"""Operator 5: language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text (A-Z as a-z) as they run, spaces, digits and signs included, in
both directions, labels every byte and is trained by backpropagation through time in numpy. Long
texts are read in windows of WINDOW bytes that overlap by MARGIN bytes on either side: a byte takes
its label from the window in which it is not in a margin, so each has read MARGIN bytes or more of
its surroundings in both directions. Places before and behind the text are a byte of their own. The
probabilities of a document are the mean over the labels of its letters; bytes of no letter say
nothing about a language but for what stands around them, and a text may have any number of them.

Training reads TRAIN_DOCS labelled documents of each language at most, those with the smallest
hash of doc_id, and only rows that are not held out.

Defined cases: texts that are null, empty or without a letter get `und` and score 0; with no
labelled row every other text gets `und` and score 0 too; equal probabilities go to the language that
sorts first; a null doc_id is not held out; a row with a null lang is not learned from; repeated rows
are each answered, and learned from once; very long texts are read whole, PASS windows at a time; an
empty table gives an empty result; columns other than doc_id, text and lang are not read, or pass
through, but for those with the name of a result's column, which the result's replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm.columns import ddl, free, without
from itemforge.llm.sampling import remainder, smallest, with_texts
from itemforge.llm.storage import share
from itemforge.llm.words import Texts, slices

HIDDEN, WINDOW, MARGIN, PASS = 12, 128, 12, 512
TRAIN_DOCS, TRAIN_WINDOWS, STEPS, BATCH, RATE = 250, 4000, 350, 64, 0.015
SLICE = 1 << 20
UNKNOWN, OUTSIDE = "und", 256
NO_LETTER = np.ones(256, bool)
NO_LETTER[65:91] = NO_LETTER[97:123] = NO_LETTER[128:] = False
_ALL = np.zeros(256, bool)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


class ByteNetwork:
    """Parameters: gates by byte and direction (x), recurrent weights (u), output layer (v, b)."""

    def __init__(self, labels: list[str], seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        h, c = HIDDEN, len(labels)
        self.labels = labels
        self.p = {"x": rng.normal(0, 0.3, (2, 257, 3 * h)), "u": rng.normal(0, h**-0.5, (2, h, 3 * h)), "v": rng.normal(0, 0.3, (2, h, c)), "b": np.zeros(c)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, bytes_: np.ndarray, keep: list | None = None) -> np.ndarray:
        """bytes_: n windows of one length; class probabilities length x classes x n. Windows are the last axis throughout."""
        n, length = bytes_.shape
        h, kind, columns = HIDDEN, self.p["x"].dtype, np.ascontiguousarray(bytes_.T)
        x, u = (np.ascontiguousarray(self.p[k].transpose(0, 2, 1)) for k in "xu")
        state = np.zeros((2, h, n), kind)
        states = np.empty((2, length, h, n), kind)
        gate = np.empty((2, 3 * h, n), kind)
        for t in range(length):
            np.take(x[0], columns[t], axis=1, out=gate[0], mode="clip")
            np.take(x[1], columns[length - 1 - t], axis=1, out=gate[1], mode="clip")
            a = u @ state
            zr = _sigmoid(gate[:, : 2 * h] + a[:, : 2 * h])
            z, r, an = zr[:, :h], zr[:, h:], a[:, 2 * h :]
            new = r * an
            new += gate[:, 2 * h :]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((state, z, r, new, an))
            state = state - new
            state *= z
            state += new
            states[0, t], states[1, length - 1 - t] = state[0], state[1]
        out = self.p["v"][0].T @ states[0]
        out += self.p["v"][1].T @ states[1]
        out += self.p["b"][:, None]
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        if keep is not None:
            keep.append(states)
        return out

    def inner(self, bytes_: np.ndarray, margin: int) -> np.ndarray:
        """forward() without margin places on either side; a direction stops where only those would still need it.

        Gates and windows are the first axes here, so that a byte's values are copied together.
        """
        n, length = bytes_.shape
        h, kind, columns = HIDDEN, self.p["x"].dtype, np.ascontiguousarray(bytes_.T)
        x, u = (self.p[k].reshape(2, -1, 3, h).transpose(0, 2, 1, 3).copy() for k in "xu")
        x[:, :2] *= -1  # sigmoids are 1 / (1 + exp(-a))
        u[:, :2] *= -1
        state = np.zeros((2, n, h), kind)
        states = np.empty((2, length - 2 * margin, n, h), kind)
        gate, a = np.empty((2, 3, n, h), kind), np.empty((2, 3, n, h), kind)
        zr, z, r, new = a[:, :2], a[:, 0], a[:, 1], a[:, 2]
        with np.errstate(over="ignore"):
            for t in range(length - margin):
                np.take(x[0], columns[t], axis=1, out=gate[0], mode="clip")
                np.take(x[1], columns[length - 1 - t], axis=1, out=gate[1], mode="clip")
                np.matmul(state[:, None], u, out=a)
                zr += gate[:, :2]
                np.exp(zr, out=zr)
                zr += 1
                np.divide(1, zr, out=zr)
                new *= r
                new += gate[:, 2]
                np.tanh(new, out=new)
                state -= new
                state *= z
                state += new
                if t >= margin:
                    states[0, t - margin], states[1, length - 1 - t - margin] = state
        out = self.p["v"][0].T @ states[0].transpose(0, 2, 1)
        out += self.p["v"][1].T @ states[1].transpose(0, 2, 1)
        out += self.p["b"][:, None]
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        return out

    def gradient(self, bytes_: np.ndarray, label: np.ndarray, counted: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the mean loss over the bytes that are counted (n x length)."""
        keep: list = []
        d = self.forward(bytes_, keep)
        states, (n, length), h = keep.pop(), bytes_.shape, HIDDEN
        weight = np.ones((length, 1, n), d.dtype) if counted is None else counted.T[:, None].astype(d.dtype)
        d[:, label, np.arange(n)] -= 1
        d *= weight / max(1, weight.sum())
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["b"] = d.sum(axis=(0, 2))
        g["v"] = np.stack([(states[i] @ d.transpose(0, 2, 1)).sum(axis=0) for i in (0, 1)])
        back = np.stack([self.p["v"][i] @ d for i in (0, 1)])
        carried = np.zeros((2, h, n), d.dtype)
        steps = np.empty((2, length, 3 * h, n), d.dtype)
        for t in range(length - 1, -1, -1):
            before, z, r, new, an = keep[t]
            dh = carried + np.stack((back[0, t], back[1, length - 1 - t]))
            dn = dh * (1 - z) * (1 - new * new)
            dz = dh * (before - new) * z * (1 - z)
            dr = dn * an * r * (1 - r)
            da = np.concatenate((dz, dr, dn * r), axis=1)
            carried = dh * z + self.p["u"] @ da
            g["u"] += before @ da.transpose(0, 2, 1)
            steps[0, t], steps[1, length - 1 - t] = (np.concatenate((dz[i], dr[i], dn[i])) for i in (0, 1))
        order = np.argsort(flat := bytes_.T.ravel(), kind="stable")
        start = np.flatnonzero(np.append(True, np.diff(flat[order]) != 0))
        for i in (0, 1):
            rows = steps[i].transpose(0, 2, 1).reshape(n * length, -1)
            g["x"][i][flat[order][start]] = np.add.reduceat(rows[order], start)
        return g

    def fit(self, bytes_: np.ndarray, label: np.ndarray, seed: int = 7) -> ByteNetwork:
        """bytes_: windows; places outside of a text are not counted."""
        rng = np.random.Generator(np.random.PCG64(seed))
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, STEPS + 1):
            rows = rng.integers(0, len(label), BATCH)
            g = self.gradient(bytes_[rows], label[rows], bytes_[rows] != OUTSIDE)
            norm = float(np.sqrt(sum((d * d).sum() for d in g.values())))
            rate = RATE * min(1, 2 * (1 - step / (STEPS + 1))) * min(1.0, 1.0 / (norm + 1e-9))
            for k, d in g.items():
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self


class Windows:
    """Overlapping windows over the bytes of a column's texts."""

    def __init__(self, column: pa.Array):
        t = Texts(column, other=_ALL)
        self.data, size = t.data.astype(np.int16), np.diff(t.offsets)
        step = WINDOW - 2 * MARGIN
        count = -(-size // step)
        self.doc = np.repeat(np.arange(t.n), count)
        at = np.arange(len(self.doc)) - np.repeat(np.cumsum(count) - count, count)
        #: First byte, in the text's place, whose label the window gives, and the end of these.
        self.low, self.high = t.offsets[:-1][self.doc], t.offsets[1:][self.doc]
        self.start = self.low + at * step

    def bytes_of(self, rows: np.ndarray) -> np.ndarray:
        place = self.start[rows][:, None] - MARGIN + np.arange(WINDOW)
        inside = (place >= self.low[rows][:, None]) & (place < self.high[rows][:, None])
        return np.where(inside, self.data[np.where(inside, place, 0)], np.int16(OUTSIDE))

    def letters(self, bytes_: np.ndarray) -> np.ndarray:
        """Which of the bytes that are not in a margin are letters."""
        own = bytes_[:, MARGIN : WINDOW - MARGIN]
        return (own != OUTSIDE) & ~np.append(NO_LETTER, True)[own]


def train(docs: DataFrame) -> ByteNetwork | None:
    """docs: doc_id, text, lang; None without a labelled row."""
    labelled = docs.where("lang is not null and text is not null").where(remainder(3) != 1)
    rows = with_texts(labelled, smallest(labelled, "lang", TRAIN_DOCS), "lang").toArrow()
    labels = sorted(set(rows.column("lang").to_pylist()))
    texts = rows.column("text").combine_chunks()
    windows = Windows(texts if isinstance(texts, pa.Array) else pa.array([], pa.string()))
    if not len(windows.doc):
        return None
    label = np.searchsorted(labels, np.array(rows.column("lang").to_pylist()))[windows.doc]
    # as many windows of each language, with repetition
    rng = np.random.Generator(np.random.PCG64(11))
    rows_of = [np.flatnonzero(label == c) for c in range(len(labels))]
    chosen = np.concatenate([rng.choice(r, TRAIN_WINDOWS) for r in rows_of if len(r)])
    return ByteNetwork(labels).fit(windows.bytes_of(chosen), label[chosen])


def label_sums(net: ByteNetwork, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text the summed probabilities of its letters' labels, and the number of letters."""
    w = Windows(column)
    total, count = np.zeros((len(column), len(net.labels))), np.zeros(len(column), np.int64)
    for a in range(0, len(w.doc), PASS):
        rows = np.arange(a, min(a + PASS, len(w.doc)))
        bytes_ = w.bytes_of(rows)
        letters = w.letters(bytes_)
        prob = net.inner(bytes_, MARGIN)
        np.add.at(total, w.doc[rows], (prob * letters.T[:, None]).sum(axis=0).T)
        np.add.at(count, w.doc[rows], letters.sum(axis=1))
    return total, count


def identify(docs: DataFrame, net: ByteNetwork | None) -> DataFrame:
    """docs with lang_pred and score added."""
    docs = without(docs, "lang_pred", "score")
    names, letter = docs.columns, free(docs, "_letter")
    marked = docs.withColumn(letter, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    shared = share(docs.sparkSession, net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        for batch in batches:
            for piece in slices(batch, limit=SLICE):
                pred, score = [UNKNOWN] * piece.num_rows, np.zeros(piece.num_rows)
                if own:
                    total, count = label_sums(own, piece.column("text"))
                    ok = np.flatnonzero((count > 0) & piece.column(letter).to_numpy(zero_copy_only=False).astype(bool))
                    best = total.argmax(axis=1)
                    score[ok] = np.clip(total[ok, best[ok]] / count[ok], 0, 1)
                    for i in ok.tolist():
                        pred[i] = own.labels[best[i]]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(pred, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return marked.mapInArrow(run, ddl(docs, "lang_pred string, score double"))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")
