"""The pipeline from end to end against a plain recomputation of each stage on planted documents."""

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from itemforge.llm import language_id, piece_sampling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def words_of(text):
    return [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall((text or "").encode())]


def shingles(text, k=5):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def planted():
    rng = random.Random(8)
    fresh = iter(rng.sample(range(10**7), 60_000))
    letters = {"aa": "bcdfgklm", "bb": "бвгджзкл"}

    def word(lang):
        n, out = next(fresh), ""
        while n:
            out += letters[lang][n % 8] + ("aeio" if lang == "aa" else "аеио")[n % 4]
            n //= 8
        return out

    text = lambda lang, n: " ".join(word(lang) for _ in range(n)) + "."
    rows, gone, cut = [], set(), {}
    add = lambda t, lang="aa": rows.append((len(rows), t, lang, f"s{len(rows) % 3}", len(t) if t is not None else None)) or len(rows) - 1
    clean = [add(text(lang, rng.randint(30, 90)), lang) for lang in ("aa", "bb") * 30]
    for t in (None, "", "12 34 ...", "\n\n"):  # no language
        gone.add(add(t))
    for d in clean[:5]:  # copies and near copies
        gone.add(add(rows[d][1]))
        w = rows[d][1].split()
        w[len(w) // 2] = word("aa")
        gone.add(add(" ".join(w))) if len(w) > 45 else None
    passage = text("bb", 60)
    keeper = add(text("bb", 12) + " " + passage + " " + text("bb", 9), "bb")
    for _ in range(3):  # a passage that stays where it stands first
        before, after = text("bb", 20), text("bb", 15)
        cut[add(f"{before} {passage} {after}", "bb")] = f"{before} {after}"
    whole = text("aa", 40)
    add(text("aa", 10) + " " + whole + " " + text("aa", 30))
    items = [text("aa", 25), text("bb", 30)]
    for i, item in enumerate(items):  # benchmark passages
        gone.add(add(f"{text('aa', 20)} {item} {text('aa', 10)}"))
        gone.add(add(item, ["aa", "bb"][i]))
    long = add(" ".join(text("aa", 500) for _ in range(40)))
    return rows, items, gone, cut, keeper, long


def test_end_to_end(spark, tmp_path):
    rows, items, gone, cut, keeper, long = planted()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.withColumn("extra", F.lit(1)).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # which near copies are over the similarity that links
    sets = {r[0]: shingles(r[1]) for r in rows}
    linked = {max(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert linked <= gone and {d for d in gone if d not in linked} >= set()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "lang", "source", "ids"} <= set(out.columns)
    decoded = {r.doc_id: r[-1] for r in piece_sampling.decode(out.select("doc_id", "ids"), piece_sampling.load_vocabulary()).collect()}
    kept = {r[0]: r[1] for r in rows if r[0] not in gone}
    assert set(decoded) == set(kept)
    for d, t in kept.items():
        assert decoded[d].split() == cut.get(d, t).split(), d
        if d not in cut:
            assert decoded[d] == t
    assert keeper in decoded and long in decoded
    assert {r.doc_id: r.lang for r in out.select("doc_id", "lang").collect()} == {r[0]: r[2] for r in rows if r[0] in kept}


def test_empty_tables_and_stages(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "sentence_spans", "decontamination", "piece_sampling"]


def test_rejected_languages_by_the_operator(spark):
    docs = spark.createDataFrame([(i, t, "aa", "s", 1) for i, t in enumerate(["some words in here", None, "", "123", "ok then"])] + [(None, "no id at all", "aa", "s", 1)], SCHEMA)
    found = language_id.identify(docs, language_id.train(docs)).collect()
    want = {r.doc_id for r in found if r.lang_pred != language_id.UNKNOWN and r.score >= corpus_pipeline.LEAST_SCORE}
    got = corpus_pipeline.language_stage(spark, docs, "").collect()
    assert {r.doc_id for r in got} == want == {0, 4, None} and list(got[0].asDict()) == corpus_pipeline.COLUMNS


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES[:-1]], ids=lambda s: s[0])
def test_columns_of_documents(spark, tmp_path, stage):
    docs = spark.createDataFrame([(1, "a b c d e f g", "aa", "s", 13), (None, "a b c d e f h", "aa", None, 13), (1, "x", None, "s", 1), (2, None, "aa", "s", None)], SCHEMA)
    spark.createDataFrame([(1, "u v w x y z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = stage[1](spark, docs, str(tmp_path))
    assert got.dtypes == docs.dtypes and got.count() <= 4
