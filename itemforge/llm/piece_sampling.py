"""Operator 2: SentencePiece encoding by forward filtering and backward sampling; lossless decoding.

Pieces come from a public SentencePiece model. The scores of a unigram model are its pieces'
log-probabilities and are taken as they are; those of a BPE model are only ranks, so there a piece has
the log-probability of a Zipf law over the ranks (tokenizers are not trained here). The space mark of
the model stands for 0x20, and the byte pieces cover every other byte, so that the lattice of any
text has a path and the pieces' bytes in a row are the text, white space and control characters
included; a space mark in the text itself is covered by byte pieces.

Where no piece of the model goes over a place at which a space follows another character (so in the
default model), a text's lattice is a chain of independent lattices, its chunks; with a model that
has such pieces each text is one chunk. Forward filtering
sums over all paths of a chunk up to each byte, once for each distinct chunk; backward sampling
draws, from the chunk's end, a piece with its share of the filtered probability. Draws are a hash of
(seed, row key, place in the text, step): the same row gives the same pieces however it is
partitioned, and equal texts under other keys differ.

Defined cases: null texts give null ids and decode to null; empty texts give no ids; a null key is
0; rows with equal keys and texts give equal pieces; an empty table gives an empty result; columns
other than the key and text are not read, or pass through, but for one with the name of a result's
column, which the result's replaces. Equal shares at a node go to the piece that is longest. Texts are
taken in slices of SLICE bytes or one text, and lattices are built BLOCK bytes of chunks at a time: a
very long text without a space costs some 200 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm.columns import ddl, without
from itemforge.llm.storage import share
from itemforge.llm.words import RangeHash, Texts, U, mix, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED, ALPHA = 17, 1.0
#: Edges of lattices that a task remembers (16 bytes each), bytes of text at a time, bytes of new chunks at a time.
KEPT_EDGES, SLICE, BLOCK = 1_500_000, 1 << 19, 1 << 16
MARK = "▁"


class Vocabulary:
    """Bytes, ids and log-probabilities of the pieces; arrays of a size that the model fixes."""

    def __init__(self, pieces: list[tuple[int, bytes, bool]], alpha: float = ALPHA, scores: dict[int, float] | None = None):
        """pieces: (id, bytes, whether it stands for one raw byte); scores: log-probabilities by id, else a Zipf law over the ids."""
        self.raw = {i: b for i, b, _ in pieces}
        plain = [(i, b) for i, b, single in pieces if not single and b]
        rank = {i: r for r, (i, _) in enumerate(sorted(plain))}
        score = (lambda i: alpha * scores[i]) if scores else (lambda i: -alpha * np.log(rank[i] + 100.0))
        self.byte_id = np.zeros(256, np.int32)
        for i, b, single in pieces:
            if single:
                self.byte_id[b[0]] = i
        #: A byte piece is likelier than no path only.
        self.byte_score = min((score(i) for i, _ in plain), default=0.0) - alpha * np.log(100.0)
        #: Whether no piece goes over a place at which a space follows another character.
        self.splits = not any(b" " in b.lstrip(b" ") for _, b in plain)
        data = np.frombuffer(b"".join(b for _, b in plain), np.uint8)
        end = np.cumsum([len(b) for _, b in plain])
        start = end - [len(b) for _, b in plain]
        h = RangeHash(data)(start, end)
        order = np.argsort(h)
        self.hash, self.id = h[order], np.array([i for i, _ in plain], np.int32)[order]
        self.score = np.array([score(i) for i, _ in plain])[order]
        self.longest = max((len(b) for _, b in plain), default=1)
        #: Whether some piece begins with bytes of this hash; false alarms only cost a look-up.
        self.begins = np.zeros(1 << 22, bool)
        for n in range(1, self.longest + 1):
            long = np.flatnonzero(end - start >= n)
            self.begins[(RangeHash(data)(start[long], start[long] + n) >> U(42)).astype(np.int64)] = True


def load_vocabulary(model: str = MODEL, alpha: float = ALPHA) -> Vocabulary:
    """Reads the model on the driver; executors get arrays."""
    import sentencepiece

    if not os.path.isfile(model):
        raise FileNotFoundError(f"no SentencePiece model at {model}; give the path of one")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = []
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            pieces.append((i, bytes([int(sp.id_to_piece(i)[3:5], 16)]), True))
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces.append((i, sp.id_to_piece(i).replace(MARK, " ").encode(), False))
    values = {i: sp.get_score(i) for i, _, single in pieces if not single}
    ranked = all(float(v).is_integer() for v in values.values())
    return Vocabulary(pieces, alpha, None if ranked else values)


_NOTHING = np.zeros(256, bool)


class Lattices:
    """Filtered lattices of distinct chunks: for each node (chunk, end byte) the pieces that end there with cumulated shares."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.reset()

    def reset(self) -> None:
        self.known, self.base = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)  # edges of node n: first[n] to first[n + 1]
        self.until, self.size, self.piece = np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def add(self, hashes: np.ndarray, data: np.ndarray, ranges: RangeHash, start: np.ndarray, end: np.ndarray) -> None:
        """hashes: increasing, not known yet; start, end: their bytes in data."""
        length = end - start
        total = int(length.sum())
        chunk = np.repeat(np.arange(len(start)), length)
        low = np.cumsum(length) - length
        at = np.arange(total) - low[chunk]  # byte in the chunk
        place = start[chunk] + at
        edges = []
        alive, room = np.arange(total), length[chunk] - at
        for n in range(1, self.v.longest + 1):
            alive = alive[room[alive] >= n]
            h = ranges(place[alive], place[alive] + n)
            may = self.v.begins[(h >> U(42)).astype(np.int64)]
            alive, h = alive[may], h[may]
            x = np.minimum(np.searchsorted(self.v.hash, h), len(self.v.hash) - 1)
            ok = self.v.hash[x] == h
            edges.append((alive[ok] + n - 1, n, self.v.id[x[ok]], self.v.score[x[ok]]))
        edges = [*edges[::-1], (np.arange(total), 1, self.v.byte_id[data[place]], self.v.byte_score)]
        first = np.append(0, np.cumsum(np.bincount(np.concatenate([e[0] for e in edges]), minlength=total)))
        node, size, piece, score = np.empty(first[-1], np.int64), np.empty(first[-1], np.int32), np.empty(first[-1], np.int32), np.empty(first[-1])
        free = first[:-1].copy()
        for nodes, n, ids, scores in edges:  # longest first; at most one edge of a length at a node, besides the byte
            to = free[nodes]
            node[to], size[to], piece[to], score[to] = nodes, n, ids, scores
            free[nodes] += 1
        # all chunks in step: the filtered log-probability up to each byte
        alpha = np.zeros(total + 1)
        share = np.empty(len(node))
        by_place = np.argsort(at, kind="stable")
        cut = np.searchsorted(at[by_place], np.arange(int(at.max(initial=-1)) + 2))
        for t in range(len(cut) - 1):
            nodes = by_place[cut[t] : cut[t + 1]]
            count = first[nodes + 1] - first[nodes]
            own = np.repeat(first[nodes], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            before = np.repeat(nodes, count) - size[own]
            x = score[own] + np.where(size[own] > t, 0.0, alpha[before])
            heads = np.cumsum(count) - count
            top = np.maximum.reduceat(x, heads)
            x = np.exp(x - np.repeat(top, count))
            sum_ = np.add.reduceat(x, heads)
            alpha[nodes] = top + np.log(sum_)
            share[own] = x / np.repeat(sum_, count)
        until = np.cumsum(share)
        until -= np.repeat(until[first[:-1]] - share[first[:-1]], np.diff(first))
        until[first[1:] - 1] = 1.0
        base = len(self.first) - 1
        self.until = np.concatenate((self.until, until))
        self.first = np.concatenate((self.first, first[1:] + len(self.size)))
        self.size, self.piece = np.concatenate((self.size, size)), np.concatenate((self.piece, piece))
        known = np.concatenate((self.known, hashes))
        order = np.argsort(known, kind="stable")
        self.known, self.base = known[order], np.concatenate((self.base, base + low))[order]

    def bases(self, hashes: np.ndarray) -> np.ndarray:
        """First node of each chunk, -1 for unknown ones."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        x = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[x] == hashes, self.base[x], -1)


def chunks(t: Texts, splits: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of the chunks: they begin with a text and, if it splits, before each space that follows another character."""
    head = np.zeros(len(t.raw) + 1, bool)
    if splits:
        space = t.raw == 32
        head[1:-1] = space[1:] & ~space[:-1]
    lengths = np.diff(t.offsets)
    head[t.offsets[:-1][lengths > 0]] = True
    head[-1] = False
    start = np.flatnonzero(head)
    return start, np.append(start[1:], len(t.raw))[: len(start)], np.searchsorted(t.offsets, start, side="right") - 1


def sample(lattices: Lattices, column: pa.Array, keys: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row and the offsets of each text."""
    t = Texts(column, lower=False, other=_NOTHING)
    start, end, doc = chunks(t, lattices.v.splits)
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(t.n + 1, np.int64)
    ranges = RangeHash(t.raw)
    h = ranges(start, end)
    distinct, at, back = np.unique(h, return_index=True, return_inverse=True)
    if len(lattices.size) > KEPT_EDGES:
        lattices.reset()
    new = np.flatnonzero(lattices.bases(distinct) < 0)
    block = np.cumsum(end[at[new]] - start[at[new]]) // BLOCK
    for own in np.split(new, np.flatnonzero(np.diff(block)) + 1) if len(new) else ():
        lattices.add(distinct[own], t.raw, ranges, start[at[own]], end[at[own]])
    base = lattices.bases(distinct)[back]
    draw = mix(mix(keys.astype(np.uint64)[doc] + U(seed * 0x9E3779B97F4A7C15 % (1 << 64))) ^ (start - t.offsets[doc]).astype(np.uint64))
    left, live, found = (end - start), np.arange(len(start)), []
    step = 0
    while len(live):
        node = base[live] + left[live] - 1
        u = (mix(draw[live] + U(step)) >> U(11)).astype(np.float64) / (1 << 53)
        edge = lattices.first[node]
        more = np.flatnonzero(lattices.until[edge] <= u)  # the last share of a node is 1
        while len(more):
            edge[more] += 1
            more = more[lattices.until[edge[more]] <= u[more]]
        left[live] -= lattices.size[edge]
        found.append((start[live] + left[live], lattices.piece[edge]))
        live = live[left[live] > 0]
        step += 1
    at, piece = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(at, kind="stable")
    return piece[order], np.searchsorted(at[order], t.offsets)


def _keys(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def encode(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """docs with ids (array of int) added."""
    docs = without(docs, "ids")
    names, shared = docs.columns, share(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(shared())
        for batch in batches:
            for piece in slices(batch, limit=SLICE):
                ids, offsets = sample(lattices, piece.column("text"), _keys(piece.column(key)), seed)
                null = piece.column("text").is_null()
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=np.append(null.to_numpy(zero_copy_only=False), False)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), lists], names=[*names, "ids"])

    return docs.mapInArrow(run, ddl(docs, "ids array<int>"))


class Decoder:
    """Bytes of sequences of ids."""

    def __init__(self, vocabulary: Vocabulary):
        raw = [vocabulary.raw.get(i, b"") for i in range(max(vocabulary.raw, default=-1) + 1)]
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(b) for b in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def __call__(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """offsets: where each sequence begins in ids, and the end of the last."""
        size = self.size[ids]
        ends = np.append(0, np.cumsum(size))
        place = np.repeat(self.start[ids] - ends[:-1], size) + np.arange(ends[-1])
        out, at = self.data[place].tobytes(), ends[offsets].tolist()
        return [out[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """encoded (with ids) with decoded added: the texts that the ids stand for."""
    encoded = without(encoded, "decoded")
    names, shared = encoded.columns, share(encoded.sparkSession, Decoder(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = shared()
        for batch in batches:
            lists = batch.column("ids")
            sizes = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            out = decoder(lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes)).astype(np.int64))
            null = lists.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([None if n else x.decode() for x, n in zip(out, null, strict=True)], pa.string())], names=[*names, "decoded"])

    return encoded.mapInArrow(run, ddl(encoded, "decoded string"))


def digest(docs: DataFrame, vocabulary: Vocabulary, seed: int = SEED) -> DataFrame:
    """doc_id, n_bytes, n_pieces, ids_crc32 (of the ids as little-endian 32-bit), decoded_crc32, lossless of every row."""
    shared = share(docs.sparkSession, (vocabulary, Decoder(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_vocabulary, decoder = shared()
        lattices = Lattices(own_vocabulary)
        for batch in batches:
            for piece in slices(batch.select(["doc_id", "text"]), limit=SLICE):
                texts = piece.column("text").cast(pa.large_binary())
                ids, offsets = sample(lattices, texts, _keys(piece.column("doc_id")), seed)
                back = decoder(ids, offsets)
                own = texts.to_pylist()
                spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id").cast(pa.int64()),
                        pa.array([None if x is None else len(x) for x in own], pa.int64()),
                        pa.array([None if x is None else b - a for x, (a, b) in zip(own, spans, strict=True)], pa.int64()),
                        pa.array([None if x is None else zlib.crc32(ids[a:b].astype("<i4").tobytes()) for x, (a, b) in zip(own, spans, strict=True)], pa.int64()),
                        pa.array([None if x is None else zlib.crc32(y) for x, y in zip(own, back, strict=True)], pa.int64()),
                        pa.array([x is None or x == y for x, y in zip(own, back, strict=True)], pa.bool_()),
                    ],
                    names=["doc_id", "n_bytes", "n_pieces", "ids_crc32", "decoded_crc32", "lossless"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_pieces long, ids_crc32 long, decoded_crc32 long, lossless boolean")


def unigram_pieces(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """piece, n: how often each piece was sampled over all rows."""
    return encode(docs.select("doc_id", "text"), vocabulary).select(F.explode("ids").alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
