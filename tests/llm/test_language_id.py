"""Held-out accuracy, and the filter against sets of n-grams."""

import random
from collections import Counter

import numpy as np
from conftest import DATA
from pyspark.sql import functions as F

from tidewheel.llm import language_id


def test_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet(DATA.replace("0.001", "0.01") + "/documents.parquet").withColumn("held_out", language_id.fold(F.col("doc_id")) == 0)
    fitted = language_id.fit(docs.filter("not held_out"))
    out = language_id.predict(docs.filter("held_out"), fitted, keep=("doc_id", "lang"))
    assert out.filter("lang = lang_pred").count() >= 0.97 * out.count() > 0
    assert out.filter("score < 0 or score > 1").count() == 0


def test_filter_answers_for_all_languages(spark):
    rows = [(k, t, g) for k, (t, g) in enumerate([("the cat sat on the mat " * 3, "aa"), ("der hund lief über den hof " * 3, "bb"), ("the hof the hof the hof the hof", "aa"), (None, "aa"), ("x", None)])]
    fitted = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert fitted.languages == ["aa", "bb"]
    hashed, _, _ = language_id.grams(["the"])
    assert set(fitted.contained(hashed).ravel().tolist()) == {1}
    langs, scores = fitted.predict(["the mat", "ÜBER DEN HUND", "", "123 !", "q"])
    assert langs == ["aa", "bb", "und", "und", "aa"] and scores[2:] == [0.0, 0.0, 0.0]


def test_filter_against_sets(spark):
    rng = random.Random(3)
    syllables = {g: ["".join(rng.choices("abcdefghijklmnop", k=3)) for _ in range(12)] for g in ("aa", "bb", "cc")}
    rows = [(k, " ".join("".join(rng.choices(syllables[g], k=3)) for _ in range(40)), g) for k, g in enumerate(["aa", "bb", "cc"] * 8)]
    fitted = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {g: Counter() for g in syllables}
    for _, text, g in rows:
        counts[g].update(language_id.grams([text])[0].tolist())
    share = {g: {x: n / sum(c.values()) for x, n in c.items()} for g, c in counts.items()}
    top = {x: max(share[g].get(x, 0) for g in share) for g in share for x in share[g]}
    sets = {g: {x for x, n in counts[g].items() if n >= language_id.LEAST and share[g][x] >= language_id.SHARE * top[x]} for g in counts}
    every = sorted(top)
    masks = fitted.contained(np.array(every, np.uint64))[:, 0]
    for k, g in enumerate(fitted.languages):
        has = (masks >> masks.dtype.type(k) & masks.dtype.type(1)).astype(bool)
        assert sets[g] <= {x for x, h in zip(every, has) if h}  # no false negatives
        false = sum(1 for x, h in zip(every, has) if h and x not in sets[g])
        assert false <= 5 + 3 * fitted.false_rate[k] * len(every)


def test_more_languages_than_a_word_has_bits(spark):
    rng = random.Random(5)
    letters = [chr(0x100 + 2 * k) for k in range(120)]
    spoken = {f"l{k:02}": ["".join(rng.choices(letters, k=5)) for _ in range(6)] for k in range(70)}
    rows = [(k, " ".join(rng.choices(w, k=60)), g) for k, (g, w) in enumerate(spoken.items())]
    fitted = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(fitted.languages) == 70 and fitted.masks.shape[1] == 2
    assert fitted.predict([" ".join(w) for w in spoken.values()])[0] == list(spoken)


def test_rows_and_columns(spark):
    rows = [(1, "the cat sat on the mat", "aa"), (2, "der hund lief", "bb")] * 4
    fitted = language_id.fit(spark.createDataFrame([(k, t, g, "x", 1) for k, t, g in rows], "doc_id long, text string, lang string, bit string, gram long"))
    asked = spark.createDataFrame([(1, "the mat " * 50_000, "x"), (1, "the mat " * 50_000, "x"), (None, None, "y")], "doc_id long, text string, lang_of string")
    assert sorted(map(tuple, language_id.predict(asked, fitted, keep=("doc_id", "lang_of")).select("lang_pred", "lang_of").collect())) == [("aa", "x"), ("aa", "x"), ("und", "y")]


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    fitted = language_id.fit(empty)
    rows = spark.createDataFrame([(1, "text"), (None, None)], "doc_id long, text string")
    assert {r.lang_pred for r in language_id.predict(rows, fitted).collect()} == {"und"}
    assert language_id.predict(empty, fitted).count() == 0
