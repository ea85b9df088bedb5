"""Operators against brute force, round trips and held-out accuracy; edge cases of each."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from itemforge.llm import components, decontamination, jaccard_join, kd_sharding, language_id, license_scan, piece_sampling, pitman_yor, sampling, sentence_spans, simhash, stirling, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def words_of(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def shingles(words, k=5):
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [tuple(words)] if words else []


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7), (11, 9), (None, 1)]
    got = {r.id: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 11: 8}


def test_jaccard_brute(docs, corpus):
    sets = {d: set(shingles(words_of(t))) for d, t, *_ in corpus}
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            label[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {d: (len(s), find(d)) for d, s in sets.items()}


def sentences_of(text):
    """Lists of words, by an own reading of the rules."""
    out = []
    for line in (text or "").split("\n"):
        own = []
        for w in WORD.findall(line.encode()):
            own.append(re.sub(rb"[A-Z]", lambda m: m[0].lower(), w))
            if re.search(rb"[.!?][\"')\]}]{0,2}$", w):
                out.append(own)
                own = []
        out.append(own)
    return [x for x in out if x]


def test_spans_brute(docs, corpus):
    first, places = {}, {}
    for d, t, *_ in sorted(corpus):
        cuts = sentences_of(t)
        words, begin = [w for x in cuts for w in x], np.cumsum([0, *map(len, cuts)])
        own = [(tuple(words[i : i + 25]), i) for i in range(len(words) - 24)]
        for i in range(len(cuts)):
            j = next((j for j in range(i + 2, len(cuts) + 1) if begin[j] - begin[i] >= 16), None)
            if j:
                own.append((("run", *words[begin[i] : begin[j]]), int(begin[i])))
        for key, at in sorted(own, key=lambda x: x[1]):
            if first.setdefault(key, (d, at)) != (d, at):
                places.setdefault(d, set()).update(range(at, at + len(key) - (key[0] == "run")))
    want = {d: len(places.get(d, ())) for d, *_ in corpus}
    got = {r.doc_id: r for r in sentence_spans.deduplicate(docs.selectExpr("*", "1 as _id", "2 as _Runs", "3 as N_units")).collect()}
    assert {d: r.n_removed for d, r in got.items()} == want
    texts = {d: t for d, t, *_ in corpus}
    assert all(got[d].text == texts[d] for d, n in want.items() if not n)
    shared = [d for d, t, *_ in corpus if t and "Shared passage" in t]
    assert ["Shared passage begins" in got[d].text for d in shared] == [True] + [False] * (len(shared) - 1)
    assert set(got[shared[0]].asDict()) >= {"part", "source", "_id", "_Runs"}


def test_short_sentence_runs(spark):
    """Runs of several sentences go whole though they have fewer words than a window; a single sentence stays."""
    run = "The first one has eight words in it. Then (a second one) that has nine of them!"
    rows = [(1, f"Own words here. {run} More of it"), (2, f"Other text.\n{run}\nand its end"), (3, "The first one has eight words in it. Something else."), (4, f"{run} Once more. {run} Bye.")]
    got = {r.doc_id: r.text.split() for r in sentence_spans.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1].split(), 2: "Other text. and its end".split(), 3: rows[2][1].split(), 4: "Once more. Bye.".split()}


def test_decontamination_brute(spark, docs, corpus):
    texts = {d: t for d, t, *_ in corpus if t}
    long = [t for t in texts.values() if 20 < len(t.split()) < 200][:8]
    items = [(i, " ".join(t.split()[2:19])) for i, t in enumerate(long)] + [(90, "one two three"), (91, ""), (92, None), (93, " ".join(long[0].split()[:15]) + " x y")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in texts.items():
        w = words_of(t)
        for i, text in items:
            own = words_of(text)
            n = min(len(own), len(w))
            goal = Counter(shingles(own))
            for p in range(len(w) - n + 1 if own else 0):
                here = Counter(shingles(w[p : p + n]))
                if len(own) < 5:
                    ok = w[p : p + n] == own
                else:
                    ok = n >= 5 and 100 * sum((here & goal).values()) >= 75 * sum((here | goal).values())
                if ok:
                    want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminations(docs, bench).collect()}
    assert got == want
    kept = {r.doc_id for r in decontamination.decontaminate(docs, bench).collect()}
    assert kept == {d for d, *_ in corpus} - {d for d, _ in want}
    assert decontamination.contaminations(docs, bench.limit(0)).count() == 0


def test_pieces_round_trip(docs, corpus):
    v = piece_sampling.load_vocabulary()
    rows = piece_sampling.decode(piece_sampling.encode(docs, v), v).collect()
    assert all(r.decoded == r.text for r in rows)
    decoder = piece_sampling.Decoder(v)
    odd = ["a▁b  c\x00\n\t é😀", "▁", " ", "x" * 3000, "", None, "long " * 40_000]
    for text in odd:
        ids, off = piece_sampling.sample(piece_sampling.Lattices(v), pa.array([text], pa.string()), np.array([5]))
        assert decoder(ids, off) == [(text or "").encode()]
    again = {r.doc_id: r.ids for r in piece_sampling.encode(docs.repartition(7), v).collect()}
    assert again == {r.doc_id: r.ids for r in rows}
    with pytest.raises(FileNotFoundError, match="nowhere"):
        piece_sampling.load_vocabulary("/nowhere/x.model")


def segmentations(word, pieces):
    return [()] if not word else [(p, *rest) for p in pieces if word.startswith(p) for rest in segmentations(word[len(p) :], pieces)]


@pytest.mark.parametrize("own", [None, {0: -1.0, 1: -2.5, 2: -1.2, 3: -3.0, 4: -2.0, 5: -2.0}])
def test_pieces_distribution(own):
    """Sampled segmentations have the lattice's exact probabilities, all of them; also over inner spaces and with a model's own scores."""
    names = [b"a", b"b", b"ab", b"ba", b"aba", b"a b"]
    v = piece_sampling.Vocabulary([(i, b, False) for i, b in enumerate(names)] + [(10 + i, bytes([i]), True) for i in range(256)], scores=own)
    score = own or {i: -np.log(i + 100.0) for i in range(len(names))}
    scores = {b: score[i] for i, b in enumerate(names)}
    for word in (b"aba", b"ab a bab"):
        single = {bytes([c]) for c in word}
        # a byte piece stands beside a plain piece of the same byte
        ways = {}
        for seg in segmentations(word, list(dict.fromkeys([*names, *single]))):
            ways[seg] = np.exp(sum(np.logaddexp(scores[p], v.byte_score) if p in scores and len(p) == 1 else scores.get(p, v.byte_score) for p in seg))
        total, n = sum(ways.values()), 40_000
        ids, off = piece_sampling.sample(piece_sampling.Lattices(v), pa.array([word.decode()] * n), np.arange(n))
        raw = v.raw
        seen = Counter(tuple(raw[i] for i in ids[a:b]) for a, b in zip(off[:-1], off[1:], strict=True))
        assert set(seen) <= set(ways)
        assert max(abs(seen[s] / n - w / total) for s, w in ways.items()) < 0.01


def test_pitman_yor(docs, corpus, spark):
    rows = pitman_yor.score(docs).collect()
    train = [t for d, t, *_ in corpus if zlib.crc32(str(d).encode()) % 7 != 2]
    tokens = Counter(w for t in train for w in words_of(t))
    total = sum(tokens.values()) + len(train)
    v = len(tokens) + 2  # the end is a token, unknown words are one more
    texts = {d: t for d, t, *_ in corpus}
    for r in rows:
        own = words_of(texts[r.doc_id])
        c = [tokens[w] for w in own] + [len(train)]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(c), sum(x > 0 for x in c), total)
        assert r.base_score == pytest.approx(sum(np.log10((x + 1) / (total + v)) for x in c))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert pitman_yor.score(docs.limit(0)).count() == 0


def sent_blob(rows):
    """A blob of (context, word, n, learn), as a map task sends it."""
    words, contexts = (np.unique(np.array(c, np.uint64)) for c in zip(*[(r[1], r[0]) for r in rows], strict=True))
    rows = sorted(rows)
    size = [sum(r[0] == c for r in rows) for c in contexts]
    return pitman_yor.pack(words, contexts, np.array(size), np.searchsorted(words, np.array([r[1] for r in rows], np.uint64)), np.array([r[2] for r in rows]), np.array([int(r[3]) for r in rows]), np.arange(2), np.array([False, True]))


@pytest.mark.parametrize("hot", [[], [7]])
def test_restaurants_sum_to_one(hot):
    rng = np.random.default_rng(3)
    rows = [(c, w, int(rng.integers(1, 900)), bool(rng.random() < 0.8)) for c in (5, 7, 9, 11) for w in range(20, 70) if rng.random() < 0.5]
    own = pitman_yor.Restaurants([sent_blob(rows[:40]), sent_blob(rows[40:])], np.array(hot, np.uint64))
    root = rng.dirichlet(np.ones(len(own.words)))
    at = own.contexts.searchsorted(7)
    own.open(root, np.array([[own.customers()[at], own.dishes()[at]]]))
    for i in range(3):
        own.sweep(i)
        for v in range(len(own.contexts)):
            p = own.predict(np.full(len(own.words), v), np.arange(len(own.words)))
            assert p.sum() == pytest.approx(1) and (p > 0).all()
    assert (own.t >= 1).all() and (own.t <= own.n).all() and (own.t[own.n > 100] > 1).any()


def test_root_and_restaurants_are_sampled_together(spark, docs):
    """In every state that is kept the root's customers are the tables of the restaurants, and no longer one for each word and context."""
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), F.lit(True).alias("learn"))
    table = pitman_yor.contexts_of_words(rows, 5, 3, pitman_yor.hot_words(docs)).cache()
    kinds = {r.kind: [x.blob for x in table.collect() if x.kind == r.kind] for r in table.collect()}
    roots = [pitman_yor.Root(b) for b in kinds[pitman_yor.ROOT]]
    hot = pitman_yor.unpack(kinds[pitman_yor.DOCS][0])[0].reshape(-1, 2)
    known, states = pitman_yor.sample(table, sum(len(x.words) for x in roots), hot[:, 1])
    fixed = {r.part: pitman_yor.unpack(r.blob) for r in table.collect() if r.kind == pitman_yor.SEATS}
    tables = np.zeros(pitman_yor.SAMPLES)
    for r in known.collect():
        if r.kind == pitman_yor.SEATS:
            _, single, size, _, _, _, n = fixed[r.part]
            kept = pitman_yor.unpack(r.state)
            assert len(kept) == pitman_yor.SAMPLES and all((t >= 1).all() and (t <= n).all() for t in kept)
            tables += [single.sum() + t.sum(dtype=float) for t in kept]
    begin = sum(int(x.n.sum()) for x in roots)
    assert tables.tolist() == [customers for customers, _, _ in states] and min(tables) > begin
    assert all(0 < t < customers for customers, t, _ in states)


@pytest.mark.parametrize("n", [2, 32, 33, 100, 256, 257, 1000])
@pytest.mark.parametrize(("others", "parent"), [(0, 0.3), (10, 0.01), (3000, 0.05)])
def test_seating_is_exact(n, others, parent):
    """Histogram of the drawn table numbers against the conditional from the full recurrence."""
    d, strength = 0.75, 5.0
    s = np.full(n + 1, -np.inf)
    s[0] = 0
    t = np.arange(1, n + 1)
    for m in range(n):
        with np.errstate(invalid="ignore", divide="ignore"):
            stay = np.where(m - t * d > 0, s[1:] + np.log(m - t * d), -np.inf)
        s = np.append(-np.inf, np.logaddexp(s[:-1], stay))
    w = s[1:] + np.cumsum(np.log(strength + d * (others + np.arange(n))) + np.log(parent))
    want = np.exp(w - w.max())
    want /= want.sum()
    k = 20_000
    got = stirling.seat(d, strength, np.full(k, float(n)), np.full(k, float(others)), np.full(k, parent), np.arange(k).astype(np.uint64) * np.uint64(77)).astype(int)
    seen = np.bincount(got, minlength=n + 1)[1:] / k
    assert np.abs(np.cumsum(seen) - np.cumsum(want)).max() < 0.02
    assert got.mean() == pytest.approx((want * t).sum(), rel=0.02)


def test_stirling_far_out():
    """Beyond the table of the recurrence the logarithm is within 0.04."""
    n = 900
    s = np.full(n + 1, -np.inf)
    s[0] = 0
    t = np.arange(1, n + 1)
    for m in range(n):
        with np.errstate(invalid="ignore", divide="ignore"):
            stay = np.where(m - t * 0.6 > 0, s[1:] + np.log(m - t * 0.6), -np.inf)
        s = np.append(-np.inf, np.logaddexp(s[:-1], stay))
    got = stirling.log_stirling(np.full(n - 5, n), t[: n - 5], 0.6)
    assert np.abs(got - s[1 : n - 4]).max() < 0.04


def test_model_sums_to_one_and_learns(spark):
    """Over all words and one unknown the probabilities after each context are 1; repeated texts are likelier than fresh ones."""
    words = ["ab", "cd", "ef", "gh"]
    train = [(i, f"{words[i % 4]} {words[(i * i) % 4]} {words[(i // 3) % 4]}") for i in range(60)]
    probes = [(1000 + i, w) for i, w in enumerate([*words, "zz", ""])]
    ids = [d for d in range(2000, 3000) if zlib.crc32(str(d).encode()) % 7 == 2][: len(probes)]
    df = spark.createDataFrame([*train, *((d, t) for d, (_, t) in zip(ids, probes, strict=True))], "doc_id long, text string")
    got = {r.doc_id: r for r in pitman_yor.score(df).collect()}
    end = {w: 10 ** got[d].score for d, (_, w) in zip(ids, probes, strict=True)}
    # a one-word text is p(word | start) p(end | word): all of them and the empty one cover no more than 1
    assert 0 < sum(end.values()) < 1
    rng = np.random.default_rng(5)
    fresh = lambda n: " ".join(str(x) for x in rng.choice([f"w{i}" for i in range(300)], n))
    texts = [fresh(40) for _ in range(150)]
    held = [d for d in range(10_000, 20_000) if zlib.crc32(str(d).encode()) % 7 == 2][:40]
    learn = [d for d in range(10_000) if zlib.crc32(str(d).encode()) % 7 != 2][:150]
    rows = [*zip(learn, texts, strict=True), *zip(held[:20], texts[:20], strict=True), *((d, fresh(40)) for d in held[20:])]
    got = {r.doc_id: r for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert min(got[d].score - got[d].base_score for d in held[:20]) > max(got[d].score - got[d].base_score for d in held[20:])


def test_language_and_toxicity(spark):
    rng = np.random.default_rng(1)
    own = {"en": "the of and to that with hing".split(), "de": "der die und nicht schön über".split()}
    rows, labels = [], []
    for i in range(300):
        lang = ("en", "de")[i % 2]
        words = [str(x) for x in rng.choice(own[lang], 25)]
        if i % 5 == 0:
            words[3] = "scum"
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(i % 5 == 0)))
    rows += [(1000, None, "en"), (1001, "", None), (1002, "12 34!", "de"), (None, "the of", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predictions(d).collect()}
    assert np.mean([got[i].lang_pred == rows[i][2] for i in range(300) if got[i].held_out]) > 0.95
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    y = spark.createDataFrame([*labels, (5000, 1), (7, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(d, y).collect()}
    assert all(got[i].predicted == labels[i][1] for i in range(300) if got[i].held_out)
    assert len(got) == len(rows) and got[1000].score == got[1001].score
    assert language_id.predictions(d.limit(0)).count() == toxicity.scored(d.limit(0), y).count() == 0
    assert {r.lang_pred for r in language_id.predictions(d.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_windows_label_every_byte():
    """Windows cover each byte once, and a label depends on the margin's surroundings alone."""
    texts = ["x" * n for n in (1, 71, 72, 73, 500)] + ["", None, "ä1 b" * 90]
    w = language_id.Windows(pa.array(texts, pa.string()))
    own = w.bytes_of(np.arange(len(w.doc)))[:, language_id.MARGIN : language_id.WINDOW - language_id.MARGIN]
    sizes = np.bincount(w.doc, weights=(own != language_id.OUTSIDE).sum(axis=1), minlength=len(texts))
    assert sizes.tolist() == [len((t or "").encode()) for t in texts]
    assert bytes(own[w.doc == 7][own[w.doc == 7] != language_id.OUTSIDE].astype(np.uint8)) == texts[7].encode()
    _, count = language_id.label_sums(language_id.ByteNetwork(["a", "b"]), pa.array(texts, pa.string()))
    assert count.tolist() == [1, 71, 72, 73, 500, 0, 0, 3 * 90]


def test_clashing_columns(spark, docs):
    """Own columns with the name of a result's column are replaced; others stay."""
    own = docs.selectExpr("doc_id", "text", "lang", "7 as score", "8 as Lang_Pred", "9 as _letter", "10 as ids", "11 as decoded", "12 as predicted").limit(30)
    net = language_id.train(docs)
    found = language_id.identify(own, net)
    assert sorted(found.columns) == sorted(["doc_id", "text", "lang", "_letter", "ids", "decoded", "predicted", "lang_pred", "score"]) and found.where("_letter = 9").count() == 30
    v = piece_sampling.load_vocabulary()
    back = piece_sampling.decode(piece_sampling.encode(own, v), v)
    assert back.where("decoded <=> text and score = 7").count() == 30
    labels = docs.selectExpr("doc_id", "cast(part % 2 as int) as toxic")
    assert toxicity.score(own, toxicity.train(docs, labels)).where("score between 0 and 1 and predicted in (0, 1) and ids = 10").count() == 30


def test_sample_is_smallest(spark):
    rows = spark.range(20_000).selectExpr("id as doc_id", "if(id % 100 = 0, 'b', 'a') as g")
    rows = rows.union(rows.where("doc_id < 5"))
    got = sampling.smallest(rows, "g", 300)
    want = rows.distinct().selectExpr("*", "row_number() over (partition by g order by pmod(xxhash64(doc_id), 1073741824), xxhash64(doc_id)) as r").where("r <= 300").drop("r")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_inner_is_forward_without_margins():
    rng = np.random.default_rng(2)
    net = language_id.ByteNetwork(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["x"] *= 20  # saturated gates too
    x = rng.integers(0, 257, (9, language_id.WINDOW)).astype(np.int16)
    for margin in (0, 1, language_id.MARGIN):
        want = net.forward(x)[margin : language_id.WINDOW - margin]
        assert np.abs(net.inner(x, margin) - want).max() < 1e-9


def test_gradient_of_network():
    net = language_id.ByteNetwork(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = np.array([[1, 2, 3, 4], [4, 3, 9, 256]]), np.array([0, 2])
    counted = x != 256
    loss = lambda: -np.log(net.forward(x)[:, y, np.arange(2)])[counted.T].mean()
    g = net.gradient(x, y, counted)
    for k, at in (("u", (1, 2, 5)), ("x", (0, 3, 7)), ("x", (1, 1, 30)), ("x", (0, 256, 2)), ("v", (1, 3, 1)), ("b", (2,))):
        keep = net.p[k][at]
        net.p[k][at] = keep + 1e-3
        up = loss()
        net.p[k][at] = keep - 1e-3
        down = loss()
        net.p[k][at] = keep
        assert g[k][at] == pytest.approx((up - down) / 2e-3, rel=0.02, abs=1e-4)


def test_sharding(docs, corpus, nothing):
    got = kd_sharding.shard_documents(docs, 4).collect()
    assert len(got) == len(corpus)
    texts = {d: t for d, t, *_ in corpus}
    slots, place, size = {}, {}, Counter()
    for r in got:
        t = texts[r.doc_id]
        assert (r.size, r.text_crc32) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
        slots.setdefault(r.shard, set()).add(r.slot)
        place.setdefault(t or "", set()).add(r.shard) if t else None
        size[r.shard] += r.size
    assert all(s == set(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in place.values())
    assert kd_sharding.shard_documents(nothing, 4).count() == 0


def test_simhash(spark, docs, corpus):
    got = {r.doc_id: r for r in simhash.fingerprint_documents(docs).collect()}
    order = sorted(got, reverse=True)
    texts = {d: t or "" for d, t, *_ in corpus}
    for i, d in enumerate(order):
        t, following = texts[d], texts[order[(i + 1) % len(order)]]
        k = len(t) // 3
        assert got[d].n_chars == len(t)
        assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - k] + following[:k]).encode()).hexdigest()
    same = {}
    for d in order:
        same.setdefault(texts[d], set()).add(got[d].fingerprint)
    assert all(len(s) == 1 for s in same.values())
    long = [d for d in order if len(texts[d]) > 300]
    assert np.mean([got[d].near_edited for d in long]) > np.mean([got[d].near_next for d in long]) + 0.1


def test_hamming_tables(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 62), 1 << 62, (40, 2))
    rows = [(int(a), int(b)) for a, b in base]
    for a, b in base[:30]:
        for flips in (1, 4, 6, 7):
            x, y = int(a) % (1 << 64), int(b) % (1 << 64)
            for f in rng.choice(128, flips, replace=False):
                if f < 64:
                    x ^= 1 << int(f)
                else:
                    y ^= 1 << int(f - 64)
            rows.append((x - (1 << 64) if x >> 63 else x, y - (1 << 64) if y >> 63 else y))
    rows = list(set(rows))
    bits = lambda p, q: sum(((s ^ t) % (1 << 64)).bit_count() for s, t in zip(p, q, strict=True))
    want = {frozenset((p, q)) for p, q in combinations(rows, 2) if bits(p, q) <= 6}
    got = simhash.near_pairs(spark.createDataFrame(rows + rows[:5], "bits_a long, bits_b long"), 6).collect()
    assert {frozenset(((r.a_bits_a, r.a_bits_b), (r.b_bits_a, r.b_bits_b))) for r in got} == want and len(got) == len(want)


def test_license_brute(spark, corpus):
    texts = [(d, t) for d, t, *_ in corpus][:40]
    notes = list(license_scan.TEMPLATES.items())
    for i, (_, note) in enumerate(notes):
        w = f"{texts[i][1]} {note.upper()} {texts[i + 12][1]}"
        texts.append((10_000 + i, w))
        texts.append((20_000 + i, note))
        cut = note.split()
        texts.append((30_000 + i, " ".join(cut[: len(cut) // 2])))
    norm = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    want = set()
    for d, t in texts:
        have = set(shingles(norm(t)))
        for name, note in notes:
            own = set(shingles(norm(note)))
            if len(own & have) >= 0.75 * len(own):
                want.add((d, name))
    df = spark.createDataFrame(texts + [(40_000, None), (40_001, "")], "doc_id long, text string")
    assert {(r.doc_id, r.license_id) for r in license_scan.scan(df).collect()} == want
    assert license_scan.collision(1 / license_scan.WINDOW, license_scan.BANDS * license_scan.WINDOW // license_scan.STRIDE) > 0.98


def test_empty_tables(spark, nothing):
    assert jaccard_join.jaccard_components(nothing).count() == 0
    assert sentence_spans.digest(nothing).count() == 0
    assert simhash.fingerprint_documents(nothing).count() == 0
    assert license_scan.scan(nothing).count() == 0
    assert piece_sampling.digest(nothing, piece_sampling.load_vocabulary()).count() == 0


def test_license_short(spark):
    rows = [(1, "A story. All rights reserved. The end of it."), (2, "all RIGHTS\nreserved"), (3, "All rights are reserved."), (4, "ALL RIGHTS RESERVED all rights reserved"), (5, "Rights reserved"), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license_id, r.first_word, r.places, r.containment) for r in license_scan.scan(df).collect()}
    assert got == {(1, "all-rights-reserved", 2, 1, 1.0), (2, "all-rights-reserved", 0, 1, 1.0), (4, "all-rights-reserved", 0, 2, 1.0)}
    own = {"one": "Copyleft", "four": "Free for all uses", "six": "No rights are reserved by anyone"}
    df = spark.createDataFrame([(1, "copyleft; free for all uses"), (2, "This is free for all. No rights are reserved by anyone"), (3, "free for all")], "doc_id long, text string")
    assert {(r.doc_id, r.license_id) for r in license_scan.scan(df, own).collect()} == {(1, "one"), (1, "four"), (2, "six")}
    with pytest.raises(ValueError, match="none"):
        license_scan.scan(df, {"none": "..."})


def test_spans_inside_sentences(spark):
    """Passages pasted in the middle of sentences, with edits between them, go from the first word to the last."""
    rng = np.random.default_rng(11)
    fresh = iter(f"w{i}" for i in rng.permutation(1_000_000))
    text = lambda n: [next(fresh) for _ in range(n)]
    rows, left = [], {}
    for i in range(60):
        n, point = int(rng.integers(51, 61)), int(rng.integers(0, 20))
        passage = text(n)
        passage[point + 10] += "." if i % 3 == 0 else "," if i % 3 == 1 else ""
        before, after, edit = text(int(rng.integers(0, 9))), text(int(rng.integers(1, 9))), text(1)
        rows.append((2 * i, " ".join(text(7) + passage + text(5))))
        twice = passage + edit + passage if i % 2 else passage
        rows.append((2 * i + 1, " ".join(before + twice + after)))
        left[2 * i + 1] = (before + edit + after if i % 2 else before + after, 2 * n if i % 2 else n)
    short = text(24)
    rows += [(1000 + i, " ".join(text(30) + short + text(30))) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in sentence_spans.deduplicate(df).collect()}
    for d, t in rows:
        words, n = left.get(d, (t.split(), 0))
        assert (got[d].text.split(), got[d].n_removed) == (words, n)
        assert got[d].kept_in == ([d - 1] if n else None)
