"""Merged transforms, and the whole operator, against counting all windows."""

import hashlib
import random
from collections import Counter

import pytest

from tidewheel.llm import bwt_dedup


def brute(texts, window=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + window] for r in raw for i in range(len(r) - window + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n, letters="abcdé \n": "".join(rng.choices(letters, k=n))
    passage, line = text(230), text(120)
    texts = ["", None, "x" * 199, "x" * 700, "ab" * 300, text(150)]
    for _ in range(12):
        base = text(rng.randrange(150, 900))
        texts.append(base)
        if rng.random() < 0.5:
            texts.append(base)
        if rng.random() < 0.6:
            at = rng.randrange(len(base))
            texts.append(base[:at] + "Q" + base[at + 1 :] + text(30))
        texts.append(text(rng.randrange(50)) + passage + text(80))
        texts.append(text(60) + line + text(100))
    texts.append(passage + text(50) + passage)
    return texts


def test_merge_against_counting():
    rng = random.Random(5)
    base = [bytes(rng.choices(b"ab", k=rng.randrange(200, 420))) for _ in range(20)]
    parts = list(base)
    for s in base:
        at = rng.randrange(len(s))
        parts.append(s[:at] + b"X" + s[at + 1 :] + bytes(rng.choices(b"ab", k=rng.randrange(150))))
    parts += [b"a" * 500, b"abc" * 150, b"q" * 200]
    seen = Counter(s[i : i + 200] for s in parts for i in range(len(s) - 199))
    for shard in (1 << 18, 3000, 500):
        for s, flags in zip(parts, bwt_dedup.repeated_windows(parts, 200, shard)):
            assert [seen[s[i : i + 200]] > 1 for i in range(len(s) - 199)] == flags.tolist()


@pytest.mark.parametrize("seed,group_bytes", [(1, 1 << 24), (2, 2000)])
def test_operator(spark, seed, group_bytes, monkeypatch):
    monkeypatch.setattr(bwt_dedup.repeated_spans, "__defaults__", ("text", "doc_id", group_bytes))
    texts = corpus(seed)
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, sha long").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in bwt_dedup.digests(df).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)


def test_edges(spark):
    assert bwt_dedup.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = "é" * 150
    rows = spark.createDataFrame([(None, twice), (None, twice), (1, "z" + twice), (1, "q")], "doc_id long, text string")
    got = sorted(r.n_removed for r in bwt_dedup.digests(rows).collect())
    assert got == [0, 300, 300, 300]
    assert sorted(r.text for r in bwt_dedup.remove(rows).collect()) == ["", "", "q", "z"]


def test_no_group_in_a_merge_is_above_its_bound(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abcde", k=n))
    passage, merged, plain = text(210), [], bwt_dedup._repeated_runs
    texts = [text(150) + passage + text(150) for _ in range(60)] + [text(400)]
    monkeypatch.setattr(bwt_dedup, "_repeated_runs", lambda dealt: merged.append(dealt) or plain(dealt))
    monkeypatch.setattr(bwt_dedup.repeated_spans, "__defaults__", ("text", "doc_id", 4000))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in bwt_dedup.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)
    largest = merged[0].selectExpr("deal", "length(bytes) AS size").groupBy("deal").agg({"size": "sum", "*": "count"}).filter("`count(1)` > 1").agg({"sum(size)": "max"}).first()[0]
    assert (largest or 0) <= 4000


def test_long_texts_and_clashing_columns(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage, long = text(300), text(1_200_000)
    rows = [(1, f"{long[:700_000]}X{passage}X{long[700_000:]}"), (2, f"{text(90)}Y{passage}Y{text(90)}"), (3, text(500)), (4, None)]
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], "doc_id long, text string, `__sha` string, `_sha` string, `_spans` string, `__key` string")
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in bwt_dedup.digests(df).collect()} == {1: (300, 1), 2: (300, 1), 3: (0, 0), 4: (0, 0)}
    out = bwt_dedup.remove(df)
    assert out.columns == df.columns
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    assert got == {1: (f"{long[:700_000]}XX{long[700_000:]}", "a", "b", "c", "d"), 2: (rows[1][1].replace(passage, ""), "a", "b", "c", "d"), 3: (rows[2][1], "a", "b", "c", "d"), 4: (None, "a", "b", "c", "d")}


def test_a_group_far_above_the_bound(spark, monkeypatch):
    rng = random.Random(13)
    text = lambda n: "".join(rng.choices("abcde", k=n))
    passage, plain = text(260), bwt_dedup.repeated_windows
    segments = [text(137) + passage + text(137) for _ in range(400)]
    own = {tuple(f.tolist()) for f in plain([s.encode() for s in segments])}
    assert all(any(f) for f in own) and sum(map(len, segments)) > 200_000
    monkeypatch.setattr(bwt_dedup.repeated_spans, "__defaults__", ("text", "doc_id", 3000))
    got = bwt_dedup.digests(spark.createDataFrame(list(enumerate(segments)), "doc_id long, text string").repartition(4)).collect()
    assert {(r.doc_id, r.n_removed) for r in got} == {(k, n) for k, (_, n, _, _) in enumerate(brute(segments))}
