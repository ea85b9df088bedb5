"""Operator 3: language-model scoring with a hierarchical Pitman-Yor model.

Restaurants: one for each word as context (the word before; at the beginning of a text the end mark),
all of which share one parent, the root, whose base is uniform over the V words of training and one
for all unknown words. Dishes are words and the end. A token's probability is that of its dish in the
restaurant of the word before it.

Contexts are as many as words, so no table of them is ever sent to all: a restaurant is whole in one
partition of the context space, and what it needs of the root, a probability for each of its dishes,
travels by join. Only words with a HOT_SHARE of the tokens or more, so a bounded number, have their
restaurant split over all partitions by dish; each part then knows the customers of the whole, and its tables
as they were at the end of the round before.

Seating is sampled by Gibbs over root and restaurants together. It starts with one table for each dish in
each restaurant. The tables of the restaurants are the root's customers, in every round anew: a round
resamples the tables of every restaurant given the root's distribution, counts them by word, resamples the
root's tables from their exact conditional (stirling) given these customers, and draws the root's distribution
given both (gammas, normalised; what falls to new tables is spread by the base, its mean). Given that
distribution restaurants are independent; within one a quarter of the dishes is taken at a time (chosen
by hash) against the tables of the others as they stand. The last SAMPLES of BURN_IN + SAMPLES states are kept whole,
tables of restaurants and root, and the predictive probabilities of each are averaged. A dish
with one customer has one table for good, so that a round moves only dishes with several and two numbers for
each word of a partition. Draws come from partition, place and round, so a rerun of a lost task repeats them.

Texts are read three times: for hot words, for the contexts of each word, and for scoring, where a
word, context and document go together once with their number; the training counts of a partition are
summed from the same rows.

Defined cases: null and empty texts are the end alone; a null doc_id has remainder 0; repeated rows
are each scored and each counted; very long texts are taken one at a time; without a row to learn from
every token has probability 1; an empty table gives an empty result; columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm.sampling import remainder
from itemforge.llm.stirling import seat
from itemforge.llm.storage import delete, materialise, scope
from itemforge.llm.words import Texts, U, mix, slices, trim

DISCOUNT, STRENGTH = (0.6, 0.75), (20.0, 2.0)  # root, words
BURN_IN, SAMPLES, COLOURS = 2, 3, 4
HOT_SHARE = 1 / 200
BYTES_PER_PART = 9_000_000
PARTS_PER_HOME = 4
FLUSH_TOKENS = 600_000
SLICE = 1 << 20
END = 0x5EED0FEA7E47E0D1
MODULUS, HELD_OUT = 7, 2
#: Kinds of rows that meet in a partition.
TOKENS, DOCS, ROOT, SEATS, TABLES, DRAWN = range(6)
#: Rows of the sampler's state; the last three columns are sums of a ROOT row.
STATE = "part int, kind int, source int, blob binary, state binary, customers double, tables double, drawn double"


def narrow(x: np.ndarray) -> np.ndarray:
    """Counts or indices in as few bytes as they need."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _planes(x: np.ndarray) -> np.ndarray:
    """Bytes of wide numbers by significance: the high ones of sorted hashes and of sums hardly change, and are compressed."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T if x.itemsize > 2 else x


def pack(*columns: np.ndarray) -> bytes:
    columns = [np.ascontiguousarray(c) for c in columns]
    head = struct.pack("<q", len(columns)) + b"".join(struct.pack("<4sq", c.dtype.str.encode(), len(c)) for c in columns)
    return head + b"".join(_planes(c).tobytes() for c in columns)


def unpack(blob: bytes) -> list[np.ndarray]:
    n = struct.unpack_from("<q", blob)[0]
    at, out = 8 + 12 * n, []
    for i in range(n):
        kind, size = struct.unpack_from("<4sq", blob, 8 + 12 * i)
        dtype = np.dtype(kind.rstrip(b"\0").decode())
        if dtype.itemsize > 2:
            out.append(np.frombuffer(blob, np.uint8, size * dtype.itemsize, at).reshape(dtype.itemsize, -1).T.copy().view(dtype).ravel())
        else:
            out.append(np.frombuffer(blob, dtype, size, at))
        at += size * dtype.itemsize
    return out


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word and document of every token, the ends included; as each document closes with its end, the token before is the context."""
    t = Texts(column)
    n = len(t.start)
    place = np.arange(n) + t.doc
    word, doc = np.full(n + t.n, U(END)), np.zeros(n + t.n, np.int64)
    word[place], doc[place] = t.hashes(), t.doc
    doc[t.first[1:] + np.arange(t.n)] = np.arange(t.n)
    return word, doc


def _split(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)).tolist():
        yield p, order[cut[p] : cut[p + 1]]


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Places of values in the increasing array of, -1 for others."""
    if not len(of):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(of, values), len(of) - 1)
    return np.where(of[at] == values, at, -1)


def hot_words(docs: DataFrame) -> np.ndarray:
    """Words with HOT_SHARE of all tokens or more (and at most those with half of it), increasing.

    A batch of tokens names its words with half that share; a word that has the share in all tokens
    is named with half of it at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush() -> pa.RecordBatch:
            word = np.concatenate(held)
            bucket = (word >> U(48)).astype(np.int64)
            word = word[np.bincount(bucket, minlength=1 << 16)[bucket] >= total * HOT_SHARE / 2]  # no other bucket can hold one
            word, n = np.unique(word, return_counts=True)
            top = n >= max(1, total * HOT_SHARE / 2)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.append(word[top].view(np.int64), 0)), pa.array(np.append(n[top], 0)), pa.array(np.append(np.zeros(top.sum(), np.int64), total))], names=["word", "n", "total"])

        for batch in batches:
            for piece in slices(batch, limit=SLICE):
                held.append(_tokens(piece.column("text"))[0])
                total += len(held[-1])
                if total >= FLUSH_TOKENS:
                    yield flush()
                    total = 0
                    trim()
        if held:
            yield flush()

    with scope(docs.sparkSession):
        found = materialise(docs.select("text").mapInArrow(run, "word long, n long, total long"), "hot")
        total = found.agg(F.sum("total")).first()[0] or 0
        sums = found.groupBy("word").agg(F.sum("n").alias("n"))
        rows = sums.where(F.col("n") >= max(1, total * HOT_SHARE / 2)).select("word").collect()  # 2 / HOT_SHARE rows at most
    return np.sort(np.array([r.word for r in rows], np.int64).view(np.uint64))


def _dense(values: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values under top, increasing, and the place of each value among them."""
    some = np.zeros(top, bool)
    some[values] = True
    kinds = np.flatnonzero(some)
    place = np.empty(top, np.int64)
    place[kinds] = np.arange(len(kinds))
    return kinds, place[values]


def _place(words: np.ndarray, w: np.ndarray, v: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """Partition of dishes w in restaurants v (indices of words); of a hot restaurant the dish decides too."""
    out = (mix(words) % U(parts)).astype(np.int64)[v]
    own = np.flatnonzero((_member(words, hot) >= 0)[v])
    out[own] = (mix(mix(words[v[own]]) + words[w[own]]) % U(parts)).astype(np.int64)
    return out


def _by_home(words: np.ndarray, homes: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of words in order of their partition in the root, and where each partition's begin."""
    home = (mix(words ^ U(0x2545F4914F6CDD1D)) % U(homes)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    return order, np.searchsorted(home[order], np.arange(homes + 1))


def _rows(rows: list[tuple]) -> pa.Table:
    """Of STATE; what a row does not have is null."""
    fields = [("part", pa.int32()), ("kind", pa.int32()), ("source", pa.int32()), ("blob", pa.binary()), ("state", pa.binary()), ("customers", pa.float64()), ("tables", pa.float64()), ("drawn", pa.float64())]
    return pa.table({name: pa.array([r[i] if i < len(r) else None for r in rows], kind) for i, (name, kind) in enumerate(fields)})


def _lists(table: pa.Table, *columns: str) -> list[tuple]:
    """Rows of a group; a side of a cogroup without rows comes without columns."""
    return list(zip(*(table.column(c).to_pylist() for c in columns), strict=True)) if table.num_rows else []


class Seats:
    """The dishes with several customers in the restaurants of a partition; a dish with one has one table for good."""

    def __init__(self, v: np.ndarray, w: np.ndarray, n: np.ndarray, fixed: np.ndarray, hot: np.ndarray, seed: int = 0):
        """v, w, n: restaurant, word and customers of each; fixed: tables of the other dishes of each restaurant; hot: its place among the hot words, or -1."""
        self.v, self.w, self.n, self.fixed, self.hot = v, w, n.astype(float), fixed, hot
        self.t, self.elsewhere = np.ones(len(n)), np.zeros(len(fixed))
        self.seeds = mix(np.arange(len(n)).astype(np.uint64) + mix(np.array([seed], np.uint64)))
        colour = self.seeds % U(COLOURS)
        self.colours = [np.flatnonzero(colour == U(c)) for c in range(COLOURS)]

    def here(self) -> np.ndarray:
        """Tables of each restaurant in this partition."""
        return self.fixed + np.bincount(self.v, weights=self.t, minlength=len(self.fixed))

    def tables(self) -> np.ndarray:
        return self.here() + self.elsewhere

    def place(self, t: np.ndarray, totals: np.ndarray) -> None:
        """Take these tables; totals: those of the hot restaurants in all partitions, in the same state."""
        self.t = t.astype(float)
        split = np.flatnonzero(self.hot >= 0)
        self.elsewhere[split] = np.maximum(0, totals[self.hot[split]] - self.here()[split])

    def sweep(self, root: np.ndarray, round_: int) -> None:
        for own in self.colours:
            if len(own):
                others = np.maximum(0, self.tables()[self.v[own]] - self.t[own])
                self.t[own] = seat(DISCOUNT[1], STRENGTH[1], self.n[own], others, root[self.w[own]], self.seeds[own] + U(round_))


def _send(parts: int, hot: np.ndarray, with_docs: bool):  # noqa: ANN202  a function of batches for mapInArrow
    """Rows (part, kind, batch, blob): dishes with their restaurants and numbers, and with_docs the documents of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            word, doc = (np.concatenate(c) for c in zip(*held, strict=True))
            row, doc_id, null, learn = (np.concatenate(c) for c in zip(*rows, strict=True))
            held.clear()
            rows.clear()
            first = int(row[0])
            words, w = np.unique(word, return_inverse=True)
            group = doc if with_docs else learn[doc].astype(np.int64)
            wide = int(group.max()) + 1
            key, n = np.unique((np.roll(w, 1) * len(words) + w) * wide + group, return_counts=True)  # the last token is an end
            group, pair = key % wide, key // wide
            w, v = pair % len(words), pair // len(words)
            out = [(int(mix(np.array([first], np.uint64))[0] % U(parts)), DOCS, pack(row, doc_id, null))] if with_docs else []
            for p, own in _split(_place(words, w, v, hot, parts), parts):
                dishes, x = _dense(w[own], len(words))
                begin = np.flatnonzero(np.append(True, v[own[1:]] != v[own[:-1]]))  # own is in order of v
                size = np.diff(np.append(begin, len(own)))
                who, there = _dense(group[own], wide)
                out.append((p, TOKENS, pack(words[dishes], words[v[own[begin]]], narrow(size), narrow(x), narrow(n[own]), narrow(there), narrow(who), learn[who] if with_docs else who.astype(bool))))
            part, kind, blob = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array([first] * len(out), pa.int64()), pa.array(blob, pa.binary())], names=["part", "kind", "batch", "blob"])

        total = docs_held = 0
        for batch in batches:
            for piece in slices(batch, limit=SLICE):
                word, doc = _tokens(piece.column("text"))
                held.append((word, doc + docs_held))
                own = piece.column("doc_id").cast(pa.int64())
                rows.append((piece.column("row").to_numpy(), own.fill_null(0).to_numpy(zero_copy_only=False), own.is_null().to_numpy(zero_copy_only=False), piece.column("learn").to_numpy(zero_copy_only=False).astype(bool)))
                docs_held += piece.num_rows
                total += len(word)
                if total >= FLUSH_TOKENS:
                    yield flush()
                    total = docs_held = 0
                    trim()
        if total:
            yield flush()

    return run


class Restaurants:
    """Customers of the restaurants of a partition: rows (context, word) in order, and all words that are asked for."""

    def __init__(self, blobs: list[bytes], hot: np.ndarray):
        opened = [unpack(b) for b in blobs]  # views of the blobs
        self.words = np.unique(np.concatenate([o[0] for o in opened]))
        self.contexts = np.unique(np.concatenate([o[1] for o in opened]))
        #: What each blob asks for: context and word as one number; n, document, who, learn.
        self.asked = []
        for words, contexts, size, w, n, there, who, learn in opened:
            rows = np.repeat(np.searchsorted(self.contexts, contexts) * len(self.words), size)
            rows += np.searchsorted(self.words, words)[w]
            self.asked.append((rows, n, there, who, learn))
        del opened
        key = np.concatenate([x[learn[there]] for x, _, there, _, learn in self.asked])
        key.sort()
        self.key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        del key
        #: The rows of what each blob asks for, -1 for none.
        self.at = [_member(x, self.key).astype(np.int32) for x, *_ in self.asked]
        self.n = np.zeros(len(self.key))
        for (_, n, there, _, learn), at in zip(self.asked, self.at, strict=True):
            some = learn[there]
            np.add.at(self.n, at[some], n[some])
        self.w, self.v = self.key % len(self.words), self.key // len(self.words)
        self.hot = _member(self.contexts, hot)

    def customers(self) -> np.ndarray:
        return np.bincount(self.v, weights=self.n, minlength=len(self.contexts))

    def dishes(self) -> np.ndarray:
        return np.bincount(self.v, minlength=len(self.contexts)).astype(float)

    def by_word(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word its restaurants, which are its tables before the first round, and its tokens of training."""
        return np.bincount(self.w, minlength=len(self.words)), np.bincount(self.w, weights=self.n, minlength=len(self.words)).astype(np.int64)

    def several(self, seed: int = 0) -> Seats:
        self.rows = np.flatnonzero(self.n > 1)
        fixed = np.bincount(self.v[self.n == 1], minlength=len(self.contexts)).astype(float)
        return Seats(self.v[self.rows], self.w[self.rows], self.n[self.rows], fixed, self.hot, seed)

    def seats(self, homes: int) -> bytes:
        """What a round needs: words by their number in the order of the root's partitions, and only restaurants with something to sample or hot ones."""
        own = self.several()
        order, cut = _by_home(self.words, homes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        single = np.bincount(self.w[self.n == 1], minlength=len(self.words))[order]
        size = np.bincount(own.v, minlength=len(self.contexts))
        some = np.flatnonzero((size > 0) | (own.hot >= 0))
        return pack(narrow(np.diff(cut)), narrow(single), narrow(size[some]), narrow(own.fixed[some].astype(np.int64)), own.hot[some].astype(np.int32), narrow(rank[own.w]), narrow(own.n.astype(np.int64)))

    def open(self, root: np.ndarray, totals: np.ndarray) -> None:
        """root: probability of each word; totals: customers and tables of the hot restaurants in all partitions."""
        self.all, self.sitting = self.customers(), self.several()
        split = np.flatnonzero(self.hot >= 0)
        self.all[split] = totals[self.hot[split], 0]
        self.t, self.above, self.kept = np.ones(len(self.n)), np.zeros(len(self.n)), []
        self.place(np.ones(len(self.rows)), root, totals[:, 1])

    def place(self, t: np.ndarray, root: np.ndarray, totals: np.ndarray) -> None:
        """A state: tables of the dishes with several customers, root, tables of the hot restaurants in all partitions."""
        self.root = root
        self.sitting.place(t, totals)
        self.t[self.rows] = self.sitting.t

    def sweep(self, round_: int) -> None:
        self.sitting.sweep(self.root, round_)
        self.t[self.rows] = self.sitting.t

    def _shares(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the present state: what each dish has for itself, what each restaurant leaves to the root."""
        return np.maximum(0, self.n - DISCOUNT[1] * self.t), STRENGTH[1] + DISCOUNT[1] * self.sitting.tables()

    def keep(self) -> None:
        """Add the state to the mean."""
        above, rest = self._shares()
        self.above += above
        self.kept.append((rest, self.root))

    def predict(self, v: np.ndarray, w: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Mean probability, over the states kept, of words after contexts (indices); at: their rows, -1 for none. Without a kept state that of the present one."""
        at = _member(v * len(self.words) + w, self.key) if at is None else at
        kept, above = self.kept, self.above
        if not kept:
            above, rest = self._shares()
            kept = [(rest, self.root)]
        below = sum(rest[v] * root[w] for rest, root in kept)
        return (np.append(above, 0)[at] + below) / (len(kept) * (STRENGTH[1] + self.all))[v]


class Root:
    """The words of a partition of the root, with its customers before the first round."""

    def __init__(self, blob: bytes):
        words, customers, tokens, *asked = unpack(blob)
        self.words, self.n, self.tokens = words, customers.astype(float), tokens.astype(np.int64)
        sources, sizes, steps = asked
        cut = np.append(0, np.cumsum(sizes)).tolist()
        #: Partitions that have asked, and the places of their words, in their order.
        self.asked = {s: np.cumsum(steps[a:b], dtype=np.int64) for s, a, b in zip(sources.tolist(), cut[:-1], cut[1:], strict=True)}


def contexts_of_words(docs: DataFrame, parts: int, homes: int, hot: np.ndarray) -> DataFrame:
    """Rows of STATE: of kind ROOT the words of a partition of the root, of kind SEATS the restaurants of a partition, of kind DOCS customers and dishes of hot restaurants."""

    def ask(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        own = Restaurants(table.column("blob").to_pylist(), hot)
        kinds, tokens = own.by_word()
        own.asked.clear()
        own.at.clear()
        order, cut = _by_home(own.words, homes)
        out = [(p, ROOT, part, pack(own.words[x], narrow(kinds[x]), narrow(tokens[x]))) for p, x in ((p, order[cut[p] : cut[p + 1]]) for p in np.flatnonzero(np.diff(cut)).tolist())]
        out.append((part, SEATS, part, own.seats(homes)))
        split = np.flatnonzero(own.hot >= 0)
        if len(split):
            out.append((0, DOCS, part, pack(own.hot[split], own.customers()[split], own.dishes()[split])))
        del own
        trim()
        return _rows(out)

    def gather(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "source", "blob")), strict=True))
        out = [(part, SEATS, s, b) for k, s, b in rows if k == SEATS]
        if totals := [unpack(b) for k, _, b in rows if k == DOCS]:
            sums = np.zeros((len(hot), 2))
            for place, customers, dishes in totals:
                sums[place, 0] += customers
                sums[place, 1] += dishes
            out.append((part, DOCS, part, pack(sums.ravel())))
        if asks := sorted((s, unpack(b)) for k, s, b in rows if k == ROOT):
            words = np.unique(np.concatenate([a[0] for _, a in asks]))
            places = [np.searchsorted(words, a[0]) for _, a in asks]
            kinds, tokens = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            for x, (_, a) in zip(places, asks, strict=True):
                kinds[x] += a[1].astype(np.int64)
                tokens[x] += a[2].astype(np.int64)
            out.append((part, ROOT, part, pack(words, narrow(kinds), narrow(tokens), np.array([s for s, _ in asks], np.int32), np.array([len(x) for x in places], np.int64), narrow(np.concatenate([np.diff(x, prepend=0) for x in places])))))
        return _rows(out)

    sent = docs.mapInArrow(_send(parts, hot, False), "part int, kind int, batch long, blob binary")
    asked = sent.select("part", "blob").groupBy("part").applyInArrow(ask, STATE)
    return asked.select("part", "kind", "source", "blob").groupBy("part").applyInArrow(gather, STATE)


def _restaurants(round_: int, base: float, rest: float, scale: float, hot_tables: np.ndarray):  # noqa: ANN202  a function of groups
    """First half of a round, in the partitions of contexts: tables given the root's distribution, counted by word for the root.

    rest, scale: what the root's draw leaves to the base, and the sum of all of it. Round 0 only counts.
    """

    def run(key: tuple, constant: pa.Table, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        rows = _lists(table, "kind", "source", "blob", "state")
        out = [(part, k, s, b, x) for k, s, b, x in rows if k == ROOT]
        state = next((x for k, _, _, x in rows if k == SEATS), None)
        for (blob,) in _lists(constant, "blob"):
            homes, single, size, fixed, hot, w, n = unpack(blob)
            own = Seats(np.repeat(np.arange(len(size)), size), w.astype(np.int64), n, fixed.astype(float), hot, part)
            kept = unpack(state) if state else [np.ones(len(n), np.uint8)]
            own.place(kept[-1], hot_tables)
            if round_:
                drawn = np.concatenate([unpack(b)[0] for _, b in sorted((s, b) for k, s, b, _ in rows if k == DRAWN)]).astype(float)
                own.sweep((drawn + rest * base) / scale, round_)
                kept = [*(kept if round_ > BURN_IN + 1 else []), narrow(own.t.astype(np.int64))]
            out.append((part, SEATS, part, None, pack(*kept)))
            number = single + np.bincount(own.w, weights=own.t, minlength=len(single)).astype(np.int64)
            cut = np.append(0, np.cumsum(homes.astype(np.int64)))
            out += [(p, TABLES, part, pack(narrow(number[cut[p] : cut[p + 1]]))) for p in np.flatnonzero(homes).tolist()]
            if len(split := np.flatnonzero(hot >= 0)):
                out.append((0, DOCS, part, pack(hot[split], own.here()[split])))
        trim()
        return _rows(out)

    return run


def _roots(round_: int, base: float, total: float, hot: int):  # noqa: ANN202  a function of groups
    """Second half: the restaurants' tables are the root's customers; its tables given them (total: all of the round before), and its distribution given both."""

    def run(key: tuple, constant: pa.Table, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        rows = _lists(table, "kind", "source", "blob", "state")
        out = [(part, k, s, b, x) for k, s, b, x in rows if k == SEATS]
        state = next((x for k, _, _, x in rows if k == ROOT), None)
        if totals := [unpack(b) for k, _, b, _ in rows if k == DOCS]:
            sums = np.zeros(hot)
            for place, tables in totals:
                sums[place] += tables
            out.append((part, DOCS, part, pack(sums)))
        for (blob,) in _lists(constant, "blob"):
            own = Root(blob)
            customers, last = np.zeros(len(own.words)), round_ == BURN_IN + SAMPLES
            for s, b in ((s, b) for k, s, b, _ in rows if k == TABLES):
                customers[own.asked[s]] += unpack(b)[0]
            t, *kept = unpack(state) if state else [np.minimum(own.n, 1)]
            t = seat(DISCOUNT[0], STRENGTH[0], customers, np.maximum(0, total - t), np.full(len(t), base), mix(own.words) + U(round_))
            above = np.maximum(0, customers - DISCOUNT[0] * t)
            if round_ > BURN_IN:
                kept.append(above.astype(np.float32))
            drawn = np.random.Generator(np.random.PCG64([part, round_])).standard_gamma(above)
            out.append((part, ROOT, part, blob if last else None, pack(narrow(t.astype(np.int64)), *kept), float(customers.sum()), float(t.sum()), float(drawn.sum())))
            if not last:
                out += [(s, DRAWN, part, pack(drawn[x].astype(np.float32))) for s, x in own.asked.items()]
        return _rows(out)

    return run


def sample(table: DataFrame, words: int, hot_dishes: np.ndarray) -> tuple[DataFrame, list[tuple[float, float, np.ndarray]]]:
    """Rows of STATE after all rounds, and of each kept state the root's customers and tables and the tables of the hot restaurants. A few numbers come back from each round."""
    base, spark, kept = 1 / (words + 1), table.sparkSession, []
    total, rest, scale, hot_tables, before = float(words), 0.0, 1.0, hot_dishes, []
    seats, roots = (table.where(f"kind = {k}").select("part", "blob").groupBy("part") for k in (SEATS, ROOT))  # these don't change
    table = table.where(f"kind = {DRAWN}")
    for i in range(BURN_IN + SAMPLES + 1):
        half = seats.cogroup(table.groupBy("part")).applyInArrow(_restaurants(i, base, rest, scale, hot_tables), STATE)
        made: list[str] = []
        table = materialise(roots.cogroup(half.groupBy("part")).applyInArrow(_roots(i, base, total, len(hot_dishes)), STATE), "round", made)
        delete(spark, before)
        before = made
        seen = table.where(f"kind = {ROOT}").agg(*[F.sum(c).alias(c) for c in ("customers", "tables", "drawn")]).first()
        sums = table.where(f"kind = {DOCS}").select("blob").collect()  # one row: a number for each hot word
        total, hot_tables = seen.tables, unpack(sums[0].blob)[0] if sums else hot_tables
        rest = float(np.random.Generator(np.random.PCG64(i)).standard_gamma(STRENGTH[0] + DISCOUNT[0] * total))
        scale = seen.drawn + rest
        if i > BURN_IN:
            kept.append((seen.customers, total, hot_tables))
    return table, kept


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BYTES_PER_PART)
    homes = min(parts, max(PARTS_PER_HOME, size // (PARTS_PER_HOME * BYTES_PER_PART)))
    hot = hot_words(docs)
    # row tells repeated rows apart; it is made once, in the pass that also carries doc_id
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), (remainder(MODULUS) != HELD_OUT).alias("learn"))
    made: list[str] = []
    table = materialise(contexts_of_words(rows, parts, homes, hot), "words", made)
    roots = table.where(f"kind = {ROOT}")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [Root(b) for b in batch.column("blob").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(x.tokens.sum()) for x in own]), pa.array([int((x.tokens > 0).sum()) for x in own])], names=["n", "words"])

    seen = roots.select("blob").mapInArrow(sums, "n long, words long").agg(*[F.sum(c).alias(c) for c in ("n", "words")]).first()
    tokens, words = seen.n or 0, seen.words or 0
    split = table.where(f"kind = {DOCS}").select("blob").collect()  # one row: two numbers for each hot word
    totals = unpack(split[0].blob)[0].reshape(-1, 2) if split else np.zeros((len(hot), 2))
    known, states = sample(table, words, totals[:, 1]) if tokens else (table, [])
    if tokens:
        delete(spark, made)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """To each partition that has asked: the training tokens of its words and the root's probabilities in each kept state. Tables of restaurants stay where they are."""
        for batch in batches:
            for part, kind, blob, state in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "blob", "state")), strict=True):
                to, blobs = [part], [state]
                if kind == ROOT:
                    own = Root(blob)
                    above = unpack(state)[1:] if states else []
                    p = [((x + (STRENGTH[0] + DISCOUNT[0] * t) / (words + 1)) / (STRENGTH[0] + n)).astype(np.float32) for x, (n, t, _) in zip(above, states, strict=True)]
                    # words with the same numbers, as most rare ones, share an entry
                    _, first, entry = np.unique(np.stack([own.tokens.astype(float), *p], axis=1), axis=0, return_index=True, return_inverse=True)
                    to, blobs = list(own.asked), []
                    for x in own.asked.values():
                        entries, at = _dense(entry.ravel()[x], len(first))
                        entries = first[entries]
                        blobs.append(pack(np.array([part], np.int32), narrow(at), narrow(own.tokens[entries]), *[y[entries] for y in p]))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([kind] * len(blobs), pa.int32()), pa.array([0] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], names=["part", "kind", "batch", "blob"])

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        kinds, batches, blobs = (right.column(c).to_pylist() for c in ("kind", "batch", "blob"))
        out = [(b, DOCS, x) for k, b, x in zip(kinds, batches, blobs, strict=True) if k == DOCS]
        mine = [(b, x) for k, b, x in zip(kinds, batches, blobs, strict=True) if k == TOKENS]
        if mine:
            own = Restaurants([x for _, x in mine], hot)
            root, count = [np.empty(len(own.words), np.float32) for _ in states], np.zeros(len(own.words), np.int64)
            order, cut = _by_home(own.words, homes)
            for kind, x in _lists(left, "kind", "blob"):
                if kind == ROOT:
                    (p,), entry, n, *values = unpack(x)
                    at = order[cut[p] : cut[p + 1]]
                    count[at] = n[entry]
                    for y, value in zip(root, values, strict=True):
                        y[at] = value[entry]
                elif tokens:
                    tables = unpack(x)
            base_ = np.log10((count + 1) / (tokens + words + 1))
            if tokens:
                own.open(root[0], totals)
                for t, y, (_, _, hot_tables) in zip(tables, root, states, strict=True):
                    own.place(t, y, hot_tables)
                    own.keep()
            for (b, _), (x, n, there, who, _), row in zip(mine, own.asked, own.at, strict=True):
                v, w = np.divmod(x, len(own.words))
                add = lambda v, at=there, size=len(who): np.bincount(at, weights=v, minlength=size)
                logs = np.log10(own.predict(v, w, row)) if tokens else np.zeros(len(x))
                out.append((b, TOKENS, pack(who, narrow(add(n)), narrow(add(n * (count[w] > 0))), add(n * base_[w]), add(n * logs))))
            del own
        trim()
        return pa.table({"batch": pa.array([b for b, *_ in out], pa.int64()), "kind": pa.array([k for _, k, _ in out], pa.int32()), "blob": pa.array([x for *_, x in out], pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        """The documents of one batch of a map task; their number is bounded by FLUSH_TOKENS, as each has a token."""
        rows = list(zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True))
        _, doc_id, null = unpack(next(b for k, b in rows if k == DOCS))
        total = np.zeros((4, len(doc_id)))
        for k, b in rows:
            if k == TOKENS:
                who, *values = unpack(b)
                total[:, who.astype(np.int64)] += np.array(values, float)
        return pa.table({"doc_id": pa.array(doc_id, mask=null), "n_tokens": total[0].astype(np.int64), "n_known": total[1].astype(np.int64), "base_score": total[2], "score": total[3]})

    schema = "part int, kind int, batch long, blob binary"
    down = known.where(f"kind in ({ROOT}, {SEATS})").select("part", "kind", "blob", "state").mapInArrow(answer, schema)
    sent = rows.mapInArrow(_send(parts, hot, True), schema)
    got = down.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(meet, "batch long, kind int, blob binary")
    sums_ = got.groupBy("batch").applyInArrow(gather, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return sums_.select("doc_id", (remainder(MODULUS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
