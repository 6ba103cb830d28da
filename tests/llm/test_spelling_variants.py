"""Near words, forms and roots against a comparison of all words, and odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewheel.llm import spelling_variants
from tidewheel.llm.spelling_variants import deletions, grouped, slipped, variants, vocabulary

LETTERS = "abéÀ÷"


def edits(word):
    """All words of the alphabet at one edit."""
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in LETTERS}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in LETTERS}
    return out - {word}


def brute(counts):
    out = {}
    for word, n in counts.items():
        own = [w for w in edits(word) if w in counts]
        best = min(own, key=lambda w: (-counts[w], w), default=None)
        form = best if best is not None and counts[best] >= 10 * n else None
        out[word] = (n, form, counts[form] if form else None, len(own))
    root = lambda w: root(out[w][1]) if out[w][1] else w
    return {w: (*x, root(w)) for w, x in out.items()}


def got(df):
    rows = df.collect()
    out = {r.word: (r.n, r.form, r.form_n, r.n_near, r.root) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_edits(spark, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choices(LETTERS, k=rng.randrange(1, 6))) for _ in range(400)}
    counts = {w: rng.choice([2, 3, 20, 21, 200, 2500]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert got(variants(df)) == brute(counts)


def test_chains_of_forms(spark):
    chain = {"abcdefg" + "h" * k: 3 * 10 ** (k + 1) for k in range(9)} | {"lonely": 5}
    out = got(variants(spark.createDataFrame(list(chain.items()), "word string, n long")))
    assert all(out[w][4] == "abcdefg" + "h" * 8 for w in chain if w != "lonely") and out["lonely"] == (5, None, None, 0, "lonely")


def test_keys_are_distinct_deletions():
    words = ["aab", "b", "ab", "xaab", "éé", "aab"]
    of, key, low, high = deletions(words)
    for k, word in enumerate(words):
        own = key[of == k]
        assert len(own) == len(set(own.tolist())) == 1 + len({word[:i] + word[i + 1 :] for i in range(len(word))})
    at = lambda word, place: key[(of == words.index(word)) & (low <= place) & (high >= place)]
    whole = lambda word: key[(of == words.index(word)) & (low == -1)]
    assert at("aab", 0) == at("aab", 1) == whole("ab") and at("ab", 0) == whole("b") and at("xaab", 0) == whole("aab") and at("xaab", 3)[0] not in whole("aab")
    assert np.array_equal(key[of == 0], key[of == 5])


def vocabulary_by_hand(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def test_vocabulary_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(spelling_variants, "HELD", 50)
    rng = random.Random(6)
    pool = ["".join(rng.choices("abcÀÉßz", k=rng.randrange(5, 10))) for _ in range(40)] + ["Straßen", "STRASSE", "x" * 3000]
    docs = [(k, rng.choice([" ", "-", "1", "\n", "ſ"]).join(rng.choices(pool, k=rng.randrange(60)))) for k in range(200)]
    docs += [(None, "question Question QUESTION"), (5, None), (6, ""), (7, "12 34"), (8, "question"), (8, "question"), (9, "questoin " * 50_000)]
    df = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, word string, n long").repartition(3)
    want = vocabulary_by_hand(docs)
    assert {r.word: r.n for r in vocabulary(df, spelt=slipped).collect()} == want and len(want) > 40
    out = got(grouped(df, spelt=slipped))
    assert {w: x[0] for w, x in out.items()} == want
    assert grouped(df.limit(0), spelt=slipped).count() == 0


def test_long_words(spark):
    """Keys of fixed size: a word of many letters meets its variants."""
    rng = random.Random(8)
    long = "".join(rng.choices("abcdefgh", k=30_000))
    words = [(long, 100), (long[:777] + long[778:], 10), (long[:5] + "z" + long[6:], 9), (long + "y", 2), (long[:1] + "q" + long[2:9] + "q" + long[10:], 2)]
    out = got(variants(spark.createDataFrame(words, "word string, n long")))
    assert out[long][3] == 3 and [out[w][1] == long for w, _ in words] == [False, True, True, True, False]
