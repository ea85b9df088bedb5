"""Operator 8: fingerprints by own votes, classes by comparing all pairs."""

import random
import re
import struct

import oracle
import pytest
import xxhash

from itemforge.llm import registry, simhash

SIGN = (1 << 64) - 1


def find(label, x):
    while label[x] != x:
        x = label[x]
    return x


def classes(prints, radius):
    """The smallest index that links of at most radius bits reach, for each of the integers."""
    label = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = sorted((find(label, i), find(label, j)))
                label[y] = x
    return [find(label, i) for i in range(len(prints))]


def halves(x):
    return struct.unpack("qq", struct.pack("QQ", x & SIGN, x >> 64))


def test_near_classes(spark):
    rng = random.Random(4)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(128), n))
    hub = rng.getrandbits(128)
    prints = [flip(hub, rng.randint(0, 9)) for _ in range(150)]  # a large group, of which many are only connected through others
    chain = [rng.getrandbits(128)]
    for _ in range(25):
        chain.append(flip(chain[-1], 6))
    prints += chain + [rng.getrandbits(128) for _ in range(40)]
    prints += [flip(prints[-1], 7), prints[-1], 0, 63, (1 << 128) - 1]
    rng.shuffle(prints)
    got = {(r.bits_a, r.bits_b): r.label for r in simhash.near_classes(spark.createDataFrame([halves(p) for p in prints], "bits_a long, bits_b long").repartition(3)).collect()}
    assert len(got) == len(set(prints))
    want, names = classes(prints, 6), {}
    for p, c in zip(prints, want, strict=True):
        assert names.setdefault(got[halves(p)], c) == c
    assert len(names) == len(set(want))
    assert simhash.near_classes(spark.createDataFrame([], "bits_a long, bits_b long")).count() == 0


def test_whole_table(spark):
    rows = registry.queries()["op8_simhash"](spark, oracle.DATA).orderBy("doc_id").collect()
    assert len(rows) == spark.read.parquet(f"{oracle.DATA}/documents.parquet").count()
    label = classes([int(r.fingerprint, 16) for r in rows], simhash.RADIUS)
    assert [r.class_id for r in rows] == [rows[i].doc_id for i in label]
    assert len(set(label)) < len(rows)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def votes(text):
    """The fingerprint by own votes of word pairs."""
    words = re.split("[ \t-\r]+", (text or "").strip(" \t\n\r\x0b\x0c").lower())
    bits, total = [0] * 128, 0
    for i, w in enumerate(words if words != [""] else []):
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        if i + 1 < len(words):
            h = xxhash.xxh64_intdigest(words[i + 1].encode(), h)
        weight = min(3, len(w) // 4 + 1)
        kept = struct.pack("q", signed((h << 4) & SIGN) >> 4)
        a = xxhash.xxh64_intdigest(kept, 42)
        b = xxhash.xxh64_intdigest(struct.pack("i", 1), a)
        total += weight
        for place in range(64):
            bits[place] += weight * (a >> place & 1)
            bits[64 + place] += weight * (b >> place & 1)
    set_ = [2 * v > total for v in bits]
    return "".join(f"{sum(1 << i for i in range(64) if set_[s + i]):016x}" for s in (0, 64))


@pytest.mark.parametrize("text", ["one", "one two three", "A b  c\nd a B c", "", None, "word " * 30 + "other", "длинное слово и ещё одно", " \t x"])
def test_votes(spark, text):
    got = simhash.fingerprint_documents(spark.createDataFrame([(1, text), (None, text)], "doc_id long, text string")).collect()
    assert {r.fingerprint for r in got} == {votes(text)}
    assert {r.class_id for r in got} == {1}
