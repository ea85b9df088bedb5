"""Operator 10: benchmark decontamination by SimHash windows and multi-index Hamming blocks.

Every benchmark item gets a 64-bit SimHash of its word pairs. Item lengths are put in classes, a
factor GROWTH apart; for each class a window of its length slides over every text, a STEP-th of its
length at a time, and gets the same fingerprint (bit votes lie eight to a word, so that prefix sums
give a window's votes by one subtraction). Fingerprints are cut in BLOCKS blocks; one table for
each block names, for every block value, the items within floor(RADIUS / BLOCKS) bits, so that no
item within RADIUS bits of a window is missed. Candidates are then verified exactly: around the
window, each run of as many words as the item has is compared by weighted shingles (runs of K words
weighted by their number): sum of minima over sum of maxima, NUM / DEN at least.

RADIUS is over three standard deviations beyond the distance expected of a window with a verified
similarity of NUM / DEN that is also off by half a step and half a class.

Items go to the executors in blocks of ITEMS_PER_PASS: a pass over the texts for each block, no
shuffle, so that neither side has to fit into memory; the driver holds the benchmark alone, and a
benchmark of a million items costs some 250 passes. Items of any length are one window each (vote
lanes get wider with the window) and are verified whole. Items of fewer than K words are met by an
equal run of words; items without words match nothing.

Defined cases: null and empty texts are clean; a text shorter than a class's window is one window;
very long texts are taken one at a time; of several places of an item in a text the one with the
highest similarity counts, the first of equal ones; a null doc_id is carried through; repeated rows
are each answered; an empty table or benchmark gives an empty result (nothing removed); other columns
are not read, or pass through, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm.storage import share
from itemforge.llm.words import Texts, U, mix, runs, slices

K, NUM, DEN = 5, 75, 100
BITS, RADIUS, BLOCKS = 64, 19, 4
GROWTH, STEP = 1.2, 8
ITEMS_PER_PASS = 4096
#: Bytes of text at a time: the arrays of a class then stay in a core's cache.
SLICE = 1 << 19
_NEAR = [x for x in range(1 << 16) if x.bit_count() <= RADIUS // BLOCKS]


def _width(n: int) -> int:
    """Bits of a lane that counts up to n votes."""
    return 8 if n <= 254 else 16 if n <= 65534 else 32


def _ones(width: int) -> np.uint64:
    return U(sum(1 << i for i in range(0, 64, width)))


def _lanes(terms: np.ndarray, width: int) -> np.ndarray:
    """width x n: lane l of row j is bit width l + j of the term's hash."""
    h = mix(terms ^ U(0x51ED270B35A4F7C3))
    return np.stack([(h >> U(j)) & _ones(width) for j in range(width)])


def _fold(votes: np.ndarray, n: np.ndarray | int, width: int) -> np.ndarray:
    """Bits whose votes are more than half of n terms (n <= 2^width - 2)."""
    half = U((1 << (width - 1)) - 1)
    add = (half - np.asarray(n, np.uint64) // U(2)) * _ones(width)
    out = np.zeros(votes.shape[1:], np.uint64)
    for j in range(width):
        # a lane reaches its top bit for more than floor(n / 2) votes, and never goes beyond
        out |= (((votes[j] + add) >> U(width - 1)) & _ones(width)) << U(j)
    return out


def simhash(words: np.ndarray) -> int:
    pairs = runs(words, 2)
    width = _width(len(pairs))
    return int(_fold(_lanes(pairs, width).sum(axis=1, dtype=np.uint64)[:, None], len(pairs), width)[0]) if len(pairs) else 0


def _class_of(n: int) -> int:
    return round(GROWTH ** round(np.log(n) / np.log(GROWTH)))


class Items:
    """Fingerprint tables of one block of items."""

    def __init__(self, rows: list[tuple]):
        texts = Texts(pa.array([t for _, t in rows], pa.string()))
        words = texts.hashes()
        self.short: dict[int, dict[int, list]] = {}
        self.classes: dict[int, list[int]] = {}
        self.ids, self.words, self.shingles, self.prints = [], [], [], []
        for i, (name, _) in enumerate(rows):
            own = words[texts.first[i] : texts.first[i + 1]]
            if 0 < len(own) < K:
                self.short.setdefault(len(own), {}).setdefault(int(runs(own, len(own))[0]), []).append(name)
            if len(own) >= K:
                self.classes.setdefault(_class_of(len(own)), []).append(len(self.ids))
                self.ids.append(name)
                self.words.append(len(own))
                self.shingles.append(runs(own, K))
                self.prints.append(simhash(own))
        self.prints = np.array(self.prints, np.uint64)
        self.any = np.unique(np.concatenate(self.shingles)) if self.shingles else np.zeros(0, np.uint64)
        #: (class, up to 64 items, a table of item bits for each block)
        self.tables = []
        near = np.array(_NEAR, np.int64)
        for size, members in sorted(self.classes.items()):
            for a in range(0, len(members), 64):
                group = members[a : a + 64]
                tables = np.zeros((BLOCKS, 1 << 16), np.uint64)
                for j, x in enumerate(group):
                    for b in range(BLOCKS):
                        tables[b][near ^ (int(self.prints[x]) >> (16 * b) & 0xFFFF)] |= U(1 << j)
                self.tables.append((size, group, tables))


def _similarity(a: np.ndarray, b: Counter, total: int) -> tuple[int, int]:
    common = sum(min(n, b[x]) for x, n in Counter(a.tolist()).items() if x in b)
    return common, len(a) + total - common


def _hits(column: pa.Array, items: Items) -> list[tuple[int, object, int, float]]:
    """(row, item, first word, similarity) of the best verified place for each row and item."""
    t = Texts(column)
    words = t.hashes()
    n, found = len(words), {}
    for k, own in items.short.items():
        h = runs(words, k)
        inside = np.arange(len(h)) + k <= t.first[1:][t.doc[: len(h)]] if len(h) else np.zeros(0, bool)
        for p in np.flatnonzero(inside & np.isin(h, np.array(list(own), np.uint64))).tolist():
            for name in own[int(h[p])]:
                found.setdefault((int(t.doc[p]), name), (p - int(t.first[t.doc[p]]), 1.0))
    if not n or not items.tables:
        return [(d, name, p, s) for (d, name), (p, s) in found.items()]
    pairs, votes, wide = np.append(runs(words, 2), U(0)), None, 0
    whole = runs(words, K)
    known = np.append(0, np.cumsum(np.isin(whole, items.any)))
    low, high = t.first[:-1], t.first[1:]
    counters: dict[int, Counter] = {}
    places: dict[tuple[int, int], list[int]] = {}
    windows: dict[int, tuple[np.ndarray, ...]] = {}
    for size, group, tables in items.tables:
        if size not in windows:
            windows.clear()
            step = max(1, size // STEP)
            count = np.where(high > low, np.maximum(0, -(-(high - low - size) // step)) + 1, 0)
            first = np.repeat(low, count) + step * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            top = np.repeat(high, count)
            first = np.maximum(np.minimum(first, top - size), np.repeat(low, count))
            last = np.minimum(first + size, top)
            if _width(size) != wide:
                wide = _width(size)
                votes = np.zeros((wide, n + 1), np.uint64)
                np.cumsum(_lanes(pairs, wide), axis=1, out=votes[:, 1:], dtype=np.uint64)
            windows[size] = first, last, _fold(votes[:, last - 1] - votes[:, first], last - first - 1, wide)
        first, last, prints = windows[size]
        mask = tables[0][(prints & U(0xFFFF)).astype(np.int64)]
        for b in range(1, BLOCKS):
            mask = mask | tables[b][(prints >> U(16 * b) & U(0xFFFF)).astype(np.int64)]
        for j, x in enumerate(group):
            rows = np.flatnonzero((mask & U(1 << j)) != 0)
            rows = rows[np.bitwise_count(prints[rows] ^ items.prints[x]) <= RADIUS]
            slack = size // STEP + abs(size - items.words[x]) + 2
            a = np.maximum(first[rows] - slack, low[t.doc[first[rows]]])
            b = np.minimum(last[rows] + slack, high[t.doc[first[rows]]])
            need = -(-NUM * len(items.shingles[x]) // DEN)
            rows = rows[known[np.clip(b - K + 1, a, len(whole))] - known[np.minimum(a, len(whole))] >= need]
            for w in rows.tolist():
                places.setdefault((int(t.doc[first[w]]), x), []).append(int(first[w]))
    for (d, x), starts in places.items():
        own, size = items.shingles[x], items.words[x]
        slack = size // STEP + abs(_class_of(size) - size) + 2
        lo, hi = int(low[d]), int(high[d])
        span = min(size, hi - lo)
        if span < K:
            continue
        tried = sorted({s for p in starts for s in range(max(lo, p - slack), min(hi - span, p + slack) + 1)})
        at = np.array(tried)
        a, b = int(at[0]), int(at[-1]) + span - K + 1
        inside = np.append(0, np.cumsum(np.isin(whole[a:b], own)))
        upper = inside[at - a + span - K + 1] - inside[at - a]
        order, best = np.argsort(-upper, kind="stable"), 0
        for o in order.tolist():
            if DEN * upper[o] < NUM * len(own) or upper[o] <= best:  # all places have as many shingles: more in common is more similar
                break
            if x not in counters:
                counters[x] = Counter(own.tolist())
            p = int(at[o])
            common, union = _similarity(whole[p : p + span - K + 1], counters[x], len(own))
            if DEN * common >= NUM * union and common > best:
                key, best = (d, items.ids[x]), common
                if key not in found or found[key][1] < common / union:
                    found[key] = (p - lo, common / union)
    return sorted(((d, name, p, s) for (d, name), (p, s) in found.items()), key=lambda r: (r[0], str(r[1])))


def _passes(bench: DataFrame) -> list[Items]:
    """The benchmark in blocks that fit into an executor; the driver holds the benchmark alone."""
    rows = [tuple(r) for r in bench.select("item_id", "text").orderBy("item_id", "text").toLocalIterator()]
    return [Items(rows[a : a + ITEMS_PER_PASS]) for a in range(0, len(rows), ITEMS_PER_PASS)]


def contaminations(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, similarity: one row for each document and item that it holds."""
    out = None
    for items in _passes(bench):
        shared = share(docs.sparkSession, items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared()
            for batch in batches:
                for piece in slices(batch, limit=SLICE):
                    hits = _hits(piece.column("text"), own)
                    ids = piece.column("doc_id").cast(pa.int64()).to_pylist()
                    cols = list(zip(*hits, strict=True)) or [(), (), (), ()]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d in cols[0]], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64())], names=["doc_id", "item_id", "first_word", "similarity"])

        found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, first_word int, similarity double")
        out = found if out is None else out.unionByName(found)
    empty = docs.select(F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("first_word"), F.lit(0.0).alias("similarity"))
    return empty.where("false") if out is None else out


def decontaminate(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item."""
    for items in _passes(bench):
        shared = share(docs.sparkSession, items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared()
            for batch in batches:
                for piece in slices(batch, limit=SLICE):
                    clean = np.ones(piece.num_rows, bool)
                    clean[[d for d, *_ in _hits(piece.column("text"), own)]] = False
                    yield piece.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
