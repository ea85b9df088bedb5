"""Operator 9: removal of repeated spans of sentences, and of words where sentences don't show them.

Words are compared without regard to white space and the case of A-Z. A sentence ends with a word that
ends in . ! or ? (closing quotes and brackets may follow) or before a line break.

Sentence spans: from every sentence the shortest run of RUN_SENTENCES consecutive sentences or more
that has RUN_WORDS words is hashed (longer runs are covered by their shortest ones); hashes meet over
the whole corpus; a run that occurs at several places stays at the first of them by (doc_id,
position), and all sentences that a later one covers are removed.

A passage that starts or ends inside a sentence, or has no sentence ends, is found by its words:
every window of WINDOW words that occurs at several places stays at the first and goes at all later
ones, word by word. So a common passage of WINDOW words or more goes from its first word to its last,
whatever stands around it, and shorter ones go if they are runs of whole sentences.

Windows are as many as words, so most are ruled out first. The anchor of a window is the run of K
words in it that has the least hash. It depends on the words of the window alone, so equal windows
have equal anchors, and a window whose anchor occurs nowhere else is not repeated. Neighbouring
windows share anchors: about one for 7 words. Then the windows of repeated anchors are compared.

Map tasks send hashes with their places, packed for each partition of the hash space; partitions
grow in number with the corpus, and a hash has one row of bytes for each map task and partition, not
one for each place. Nothing that grows with the corpus is collected.

Defined cases: null and empty texts and rows with a null doc_id stay as they are and are not
compared; rows that share a doc_id count as one document (the same span at the same place is not a
repetition); spans repeated inside one document lose all but their first; a text all of whose words
go becomes empty; very long texts are taken one at a time; an empty table gives an empty result.
Other columns pass through unread, but for those with the name of a result's column, which the
result's replaces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm.columns import ddl, free, without
from itemforge.llm.storage import materialise
from itemforge.llm.words import RangeHash, Texts, U, mix, slices

RUN_SENTENCES, RUN_WORDS = 2, 16
K, WINDOW = 13, 25
SPANS_PER_PART = 2_000_000
FLUSH_SPANS = 750_000
SLICE = 1 << 20
#: Up to so many ids of documents are sent to all executors, so that only their texts are shuffled.
BROADCAST_ROWS = 1_000_000
_STOPS, _CLOSERS = np.zeros(256, bool), np.zeros(256, bool)
_STOPS[list(b".!?")] = True
_CLOSERS[list(b"\"')]}")] = True
Places = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]


class Units:
    """Units (words) of the texts of a column: document, and the runs and windows that are compared."""

    def __init__(self, column: pa.Array):
        t = self.texts = Texts(column)
        self.hash = RangeHash(t.hashes())
        self.begin = np.arange(len(t.start))
        self.end = self.begin + 1
        #: Units of document i: first[i] to first[i + 1].
        self.doc, self.first = t.doc, t.first

    def sentences(self) -> np.ndarray:
        """First unit of every sentence, and the number of all units."""
        t, n = self.texts, len(self.begin)
        if not n:
            return np.zeros(1, np.int64)
        last = t.end - 1
        for _ in range(2):
            last = np.where(_CLOSERS[t.raw[last]] & (last > t.start), last - 1, last)
        lines = np.append(0, np.cumsum(t.raw == 10))
        after = _STOPS[t.raw[last[:-1]]] | (lines[t.start[1:]] > lines[t.end[:-1]]) | (self.doc[1:] != self.doc[:-1])
        return np.append(np.flatnonzero(np.append(True, after)), n)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first unit, end unit of the shortest run of sentences from each one that is long enough."""
        bound = self.sentences()
        s = np.arange(len(bound) - 1)
        to = np.maximum(s + RUN_SENTENCES, np.searchsorted(bound, bound[s] + RUN_WORDS))
        inside = to < len(bound)
        start, end = bound[s[inside]], bound[to[inside]]
        inside = end <= self.first[self.doc[start] + 1] if len(start) else np.zeros(0, bool)
        start, end = start[inside], end[inside]
        return self.hash(start, end), start, end

    def windows(self) -> np.ndarray:
        """First unit of each window."""
        start = np.arange(max(0, len(self.begin) - WINDOW + 1))
        return start[self.doc[start] == self.doc[start + WINDOW - 1]]

    def anchors(self) -> np.ndarray:
        """First unit of the anchor of the window at each unit (wherever a document ends); of equal hashes the first."""
        least = np.arange(max(0, len(self.begin) - K + 1))
        grams = self.hash(least, least + K)
        less = lambda a, by: np.where(grams[a[by:]] < grams[a[:-by]], a[by:], a[:-by])
        size, width = 1, WINDOW - K + 1
        while 2 * size <= width:
            least, size = less(least, size), 2 * size
        return less(least, width - size) if size < width else least

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first unit, end unit of each window."""
        start = self.windows()
        return self.hash(start, start + WINDOW), start, start + WINDOW

    def at(self, places: pa.Array) -> np.ndarray:
        """The units at the places (counted from 0 in their document) that are listed for each document."""
        count = pa.compute.list_value_length(places).fill_null(0).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(count)), count)
        unit = self.first[doc] + pa.compute.list_flatten(places).to_numpy(zero_copy_only=False).astype(np.int64)
        return unit[unit < self.first[doc + 1]]

    def without(self, gone: np.ndarray) -> pa.Array:
        """The texts without the units that are marked."""
        t = self.texts
        from_ = t.start
        to = np.append(from_[1:], len(t.raw)) if len(from_) else from_
        to = np.minimum(to, t.offsets[self.doc + 1]) if len(from_) else to
        edge = np.zeros(len(t.raw) + 1, np.int64)
        np.add.at(edge, from_[gone], 1)
        np.add.at(edge, to[gone], -1)
        keep = np.cumsum(edge)[:-1] == 0
        offsets = np.append(0, np.cumsum(keep))[t.offsets]
        return pa.Array.from_buffers(pa.large_binary(), t.n, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(t.raw[keep].tobytes())]).cast(pa.string())


def _placed(piece: pa.RecordBatch, units: Units, hashes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, doc_id, place in the document."""
    ids, doc = piece.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False), units.doc[start]
    return hashes, ids[doc], start - units.first[doc]


def _runs(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    units = Units(piece.column("text"))
    h, start, _ = units.runs()
    return _placed(piece, units, h, start)


def _anchors(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    units = Units(piece.column("text"))
    start = np.unique(units.anchors()[units.windows()])
    return _placed(piece, units, units.hash(start, start + K), start)


def _windows(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows whose anchors are at the places that the piece lists."""
    units = Units(piece.column("text"))
    marked = np.zeros(len(units.begin), bool)
    marked[units.at(piece.column("places"))] = True
    start = units.windows()
    start = start[marked[units.anchors()[start]]]
    return _placed(piece, units, units.hash(start, start + WINDOW), start)


def repeated(rows: DataFrame, parts: int, places: Places, later: bool) -> DataFrame:
    """doc_id, places, kept: the places with a hash that occurs at several places, and the documents of its first one.

    later: without the first place of each hash.
    """

    def split(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            x = order[cut[p] : cut[p + 1]]
            if len(x):
                yield p, b"".join(c[x].tobytes() for c in columns)

    def opened(table: pa.Table, *kinds: type) -> list[np.ndarray]:
        cols, width = [[] for _ in kinds], sum(np.dtype(k).itemsize for k in kinds)
        for x in table.column("blob").to_pylist():
            n, at = len(x) // width, 0
            for to, kind in zip(cols, kinds, strict=True):
                to.append(np.frombuffer(x, kind, n, at))
                at += n * np.dtype(kind).itemsize
        return [np.concatenate(c) for c in cols]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            h, d, u = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            at, blobs = zip(*split((mix(h) % U(parts)).astype(np.int64), h, d, u.astype(np.int32)), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

        count = 0
        for batch in batches:
            for piece in slices(batch, limit=SLICE):
                held.append(places(piece))
                count += len(held[-1][0])
                if count >= FLUSH_SPANS:
                    yield flush()
                    count = 0
        if count:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        h, d, u = opened(table, np.uint64, np.int64, np.int32)
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        order = order[np.append(same, False) | np.append(False, same)]  # hashes that came more than once
        h, d, u = h[order], d[order], u[order]
        order = np.lexsort((u, d, h))
        h, d, u = h[order], d[order], u[order]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, int)
        size = np.diff(np.append(start, len(h)))
        first = np.repeat(d[start], size)
        other = (d != first) | (u != np.repeat(u[start], size))
        some = other if later or not len(h) else np.repeat(np.logical_or.reduceat(other, start), size)
        d, u, first = d[some], u[some], first[some]
        at, blobs = zip(*split((mix(d.view(np.uint64)) % U(parts)).astype(np.int64), d, u, first), strict=True) if len(d) else ((), ())
        return pa.table({"part": pa.array(at, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        d, u, first = opened(table, np.int64, np.int32, np.int64)

        def lists(values: np.ndarray) -> tuple[np.ndarray, pa.Array]:
            """Documents, and the different values of each."""
            order = np.lexsort((values, d))
            doc, value = d[order], values[order]
            new = np.append(True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1]))
            doc, value = doc[new], value[new]
            start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            return doc[start], pa.ListArray.from_arrays(pa.array(np.append(start, len(doc)).astype(np.int32)), pa.array(value))

        doc, places_ = lists(u)
        return pa.table({"doc_id": doc, "places": places_, "kept": lists(first)[1]})

    sent = rows.mapInArrow(send, "part int, blob binary")
    met = sent.groupBy("part").applyInArrow(meet, "part int, blob binary")
    return met.groupBy("part").applyInArrow(gather, "doc_id long, places array<int>, kept array<long>")


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc_id, runs (first unit of each run of sentences to remove), spans (first unit of each window to remove), kept_in (ids of the documents that keep the first occurrence)."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (40 * SPANS_PER_PART))
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    none = F.lit(None).cast("array<int>")
    runs = repeated(texts, parts, _runs, later=True).select("doc_id", F.col("places").alias("runs"), none.alias("spans"), "kept")
    anchors = repeated(texts, parts, _anchors, later=False).select("doc_id", "places")
    anchors = materialise(anchors, "spans-anchors")
    size = anchors.agg(F.count("*").alias("docs"), F.sum(F.size("places")).alias("places")).first()
    if size.docs <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(anchors.select("doc_id")), "doc_id", "left_semi")
    # an anchor is that of so many windows at most
    parts = max(least, (size.places or 0) * (WINDOW - K + 1) // SPANS_PER_PART)
    hits = repeated(texts.join(anchors, "doc_id").select("doc_id", "text", "places"), parts, _windows, later=True)
    both = runs.unionByName(hits.select("doc_id", none.alias("runs"), F.col("places").alias("spans"), "kept"))
    # two rows for a document at most
    return both.groupBy("doc_id").agg(F.max("runs").alias("runs"), F.max("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("kept")))).alias("kept_in"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with their columns; text without the words of repeated spans. Adds n_units, n_removed, kept_in."""
    docs = without(docs, "n_units", "n_removed", "kept_in")
    id_, runs, spans, kept = (free(docs, n) for n in ("_id", "_runs", "_spans", "_kept"))
    side = materialise(removed_spans(docs), "spans-removed").toDF(id_, runs, spans, kept)
    joined = docs.join(side, docs.doc_id == side[id_], "left").drop(id_)
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, limit=SLICE):
                units = Units(piece.column("text"))
                start = units.at(piece.column(spans))
                edge = np.zeros(len(units.end) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, np.minimum(start + WINDOW, units.first[1:][units.doc[start]]), -1)
                _, from_, to = units.runs()
                marked = np.isin(from_, units.at(piece.column(runs)))
                np.add.at(edge, from_[marked], 1)
                np.add.at(edge, to[marked], -1)
                gone = np.cumsum(edge)[:-1] > 0
                per = np.append(0, np.cumsum(gone))
                removed = per[units.first[1:]] - per[units.first[:-1]]
                text = pa.compute.if_else(pa.array(removed > 0), units.without(gone), piece.column("text").cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*(text if c == "text" else piece.column(c) for c in names), pa.array(np.diff(units.first).astype(np.int32)), pa.array(removed.astype(np.int32)), piece.column(kept)], names=[*names, "n_units", "n_removed", "kept_in"])

    return joined.mapInArrow(cut, ddl(docs, "n_units int, n_removed int, kept_in array<long>"))


def digest(docs: DataFrame) -> DataFrame:
    """One row for each document that loses something."""
    return (
        deduplicate(docs.select("doc_id", "text"))
        .where("n_removed > 0")
        .select("doc_id", "n_units", "n_removed", F.char_length("text").cast("long").alias("n_chars_left"), F.crc32("text").alias("text_crc32"), "kept_in")
    )
