"""Hits against a scan of every place, and odd rows."""

import random
import re

import pytest

from tidewheel.llm import decontaminate as decontaminate_module
from tidewheel.llm.decontaminate import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        own = words(text)
        for at in range(max(1, len(own) - 9) if own else 0):
            windows.setdefault(tuple(own[at : at + 10]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for window, ids in windows.items():
            for at in range(len(own) - len(window) + 1):
                if tuple(own[at : at + len(window)]) == window:
                    hit |= set(range(at, at + len(window)))
                    found |= ids
        out[doc] = (len(own), len(hit), sorted(found))
    return out


def case():
    rng = random.Random(9)
    vocabulary = [f"w{k}é" for k in range(12)] + ["The", "of"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 9, 10, 11, 25])))) for k in range(30)]
    items += [(100, items[-1][1]), (101, None), (102, "..."), (103, "zz")]
    docs = []
    for k in range(40):
        own = rng.choices(vocabulary, k=rng.randrange(60))
        if k % 2:
            own[len(own) // 2 : len(own) // 2] = (rng.choice(items)[1] or "").upper().split()
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(own)))
    return [*docs, (900, None), (901, ""), (902, "zz-zz")], items


@pytest.mark.parametrize("most_bits, ranges", [(1 << 26, 16), (64, 1), (2048, 3)])
def test_against_every_place(spark, most_bits, ranges, monkeypatch):
    monkeypatch.setattr(decontaminate_module, "MOST_BITS", most_bits)  # a sieve of 64 bits lets everything through
    monkeypatch.setattr(decontaminate_module, "RANGES", ranges)
    docs, items = case()
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_words long").repartition(2)
    own = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontaminate(df, own).collect()}
    assert got == brute(docs, items)


def test_sieves_split_by_ranges(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(decontaminate_module, "MOST_BITS", 4096)
    rng = np.random.default_rng(1)
    token = rng.integers(-(2**63), 2**63 - 1, 900)
    made = decontaminate_module.sieves(spark.createDataFrame([(int(t),) for t in token], "token long"))
    assert len(made) == 4 and all(len(table) * 64 <= 4096 for *_, table in made)
    through = [decontaminate_module._sifted(token.view(np.uint64), one) for one in made]
    assert sorted(np.concatenate(through).tolist()) == list(range(900))  # each in the sieve of its range, and only there
    other = rng.integers(0, 2**63 - 1, 5000).view(np.uint64)
    assert sum(len(decontaminate_module._sifted(other, one)) for one in made) < 600


def test_edges(spark):
    docs, items = case()
    df, own = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate(df.limit(0), own).count() == 0
    assert decontaminate(df, own.limit(0)).filter("contaminated or n_items > 0").count() == 0


def test_odd_rows(spark):
    passage = " ".join(f"p{k}" for k in range(14))
    long = " ".join(f"x{k}" for k in range(200_000)) + " " + passage
    docs = [(1, passage), (1, passage), (None, passage), (2, long), (3, "clean of it"), (4, f"{passage} mid {passage}")]
    shape = "doc_id long, text string, n_words string, contaminated string, item_ids string, token long"
    df = spark.createDataFrame([(*d, "a", "b", "c", 1) for d in docs], shape)
    own = spark.createDataFrame([(None, passage), ("i", passage), ("i", passage)], "item_id string, text string")
    got = sorted(((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.item_ids, [tuple(s) for s in r.hit_spans]) for r in decontaminate(df, own).collect()), key=str)
    spans = lambda at: [(at + k, at + k + 10) for k in range(5)]
    assert got == sorted([(0, 14, 14, 2, ["i"], spans(0)), *[(1, 14, 14, 2, ["i"], spans(0))] * 2, (2, 200_014, 14, 2, ["i"], spans(200_000)), (3, 3, 0, 0, [], []), (4, 29, 28, 2, ["i"], spans(0) + spans(15))], key=str)
    clean = decontaminate_module.clean(df, own)
    assert clean.columns == df.columns and [r.doc_id for r in clean.collect()] == [3]
