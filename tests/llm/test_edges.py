"""Null and shared ids, texts over a slice, laws of sharding, tables of operators that run at once, held-out toxic texts."""

import threading
import zlib
from collections import Counter
from pathlib import Path

import pytest

from itemforge.llm import components, jaccard_join, kd_sharding, merkle_manifest, pitman_yor, registry, sentence_spans, storage
from itemforge.llm.toxicity import THRESHOLD

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["one two three four five six seven", "one two three four five six seven", "alone", None, "", "a longer text of quite other words that are new"]
ROWS = [(i, t, "aa", "s", 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "aa", None, 1), (2, TEXTS[5], None, "s", None), (2, TEXTS[5], None, "s", None), (None, None, None, None, None)]


def test_null_and_shared_ids(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    ids = Counter(r[0] for r in ROWS)
    for name in ("op1_kd_sharding", "op4_jaccard_join", "op8_simhash", "op12_merkle_manifest"):
        found = {"op1_kd_sharding": lambda: kd_sharding.shard_documents(docs, 2), "op4_jaccard_join": lambda: jaccard_join.jaccard_components(docs), "op8_simhash": lambda: registry.simhash.fingerprint_documents(docs), "op12_merkle_manifest": lambda: merkle_manifest.manifest(docs)}[name]()
        assert Counter(r.doc_id for r in found.collect()) == ids, name
    scored = pitman_yor.score(docs).collect()
    assert Counter(r.doc_id for r in scored) == ids and all(r.n_tokens == (len(t.split()) + 1 if t else 1) for r in scored if r.doc_id in (0, 3, 4) for t in [TEXTS[r.doc_id]])


def test_law_of_sharding(spark, docs):
    got = kd_sharding.shard_documents(docs, 4).collect()
    sizes, texts = Counter(), {}
    for r in got:
        sizes[r.shard] += r.size
        texts.setdefault(r.text_crc32, set()).add(r.shard)
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len((rows[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((rows[r.doc_id] or "").encode()) and r.law == "bytes" for r in got)
    largest = max(Counter({c: sum(r.size for r in got if r.text_crc32 == c) for c in texts}).values())
    assert set(sizes) == set(range(4)) and max(sizes.values()) - min(sizes.values()) <= 2 * largest
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_texts_over_a_slice(spark):
    """Texts of more than a megabyte, the largest slice of any operator."""
    words = [f"w{i * 7919 % 200_003}" for i in range(170_000)]
    long, near = " ".join(words), " ".join([*words[:-5], "other"])
    docs = spark.createDataFrame([(1, long), (2, near), (3, "short text of other words here"), (4, "x " + " ".join(words[1000:1060]) + " y")], "doc_id long, text string")
    assert len(long) > 1 << 20
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    left = {r.doc_id: r.text for r in sentence_spans.deduplicate(docs).collect()}
    assert left[1] == long and left[2].split() == ["other"] and left[4].split() == ["x", "y"]


def test_operators_at_once(spark):
    """Each keeps and deletes its own tables only."""
    results, errors = {}, []

    def run(i):
        try:
            with storage.scope(spark):
                links = spark.createDataFrame([(100 * i + j, 100 * i + j + 1) for j in range(12)], "a long, b long")
                results[i] = {r.label for r in components.components(links).collect()}
        except Exception as e:  # the thread's, told below
            errors.append(e)

    before = spark.conf.get(storage._CLEANUP, None)
    threads = [threading.Thread(target=run, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and results == {i: {100 * i} for i in range(3)}
    assert spark.conf.get(storage._CLEANUP, None) == before


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").is_dir(), reason="needs the tables of sf0.01")
def test_held_out_toxic_texts(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in registry.op6_toxicity(spark, sf).collect() if r.held_out}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in got}
    caught = sum(got[d].predicted for d, y in labels.items() if y == 1)
    flagged = sum(got[d].predicted for d, y in labels.items() if y == 0)
    assert (sum(y == 1 for y in labels.values()), sum(y == 0 for y in labels.values())) == (18, 95)
    assert caught >= 14 and flagged == 0
    assert all(r.predicted == int(r.score >= THRESHOLD) for r in got.values())
