"""The join against all pairs."""

import random
import re

import pytest

from tidewheel.llm import jaccard_join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = set()
    for x in range(len(sets)):
        for y in range(x):
            (i, a), (j, b) = sets[x], sets[y]
            if i != j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                links.add((min(i, j), max(i, j)))
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (len(s), root(i)) for i, s in sets}, links, dict(sets)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    line = " ".join(rng.choices(vocabulary, k=14))
    docs = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([3, 5, 6, 8, 9, 12, 30, 80, 200]))
        for _ in range(rng.choice([1, 1, 2, 5])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            docs.append(" ".join(own).upper() if rng.random() < 0.1 else " ".join(own))
        docs.append(line + " " + " ".join(rng.choices(vocabulary, k=rng.randrange(8))))
    docs += ["", None, " \t\n", "A b", "a B", "É x", "é x", "a b c d e", "a b c d"]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed,growth,light_to,hot", [(1, 8, None, 10_000), (2, 2, 0, 10_000), (3, 2, 6, 10_000), (4, 2, 99, 10), (5, 8, 5, 10)])
def test_against_all_pairs(spark, seed, growth, light_to, hot, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROWTH", growth)
    monkeypatch.setattr(jaccard_join, "LONG", 2)
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    if light_to is not None:  # sets of this size class and below enumerate subsets, the others scan lists
        monkeypatch.setattr(jaccard_join, "boundary", lambda tokens: light_to)
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, digest string").repartition(3)
    expected, links, sets = brute(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(df).collect()}
    assert got == expected
    lowest = {}
    for i, s in sorted(sets.items()):
        lowest.setdefault(frozenset(s), i)
    different = {(i, j) for i, j in links if sets[i] != sets[j] and lowest[frozenset(sets[i])] == i and lowest[frozenset(sets[j])] == j}
    assert {(r.a, r.b) for r in jaccard_join.links(df).collect()} == different


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.join(empty).count() == 0
    rows = [(7, "a b c"), (7, "a b c"), (3, "a b c"), (None, "a b c"), (None, "z"), (5, None)]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 1, -1), (-1, 1, 3), (3, 1, 3), (5, 0, 5), (7, 1, 3), (7, 1, 3)]


def test_both_halves_find_links(spark):
    docs = corpus(6)
    df = spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string").repartition(3)
    _, links, sets = brute(docs)
    scanned = jaccard_join._scanned(df, "doc_id", "text", 5)
    members = jaccard_join._members(scanned.filter("n is null")).groupBy("node").agg({"size": "max", "digest": "min"}).toDF("node", "size", "digest").select("node", "digest", "size")
    packed = jaccard_join._packed_tokens(df, "doc_id", "text", members, members.count(), jaccard_join.frequent_tokens(scanned), 5, 80, 8)
    lists = jaccard_join._lists(jaccard_join._shared_tokens(packed, members, 80), 80, 5)
    pairs = jaccard_join._candidates(lists.drop("center"), 1, None, 80)
    light = {(r.a, r.b) for r in jaccard_join._candidates(lists.drop("center").filter("other is not null"), 1, None, 80).collect()}
    heavy = {(r.a, r.b) for r in jaccard_join._candidates(lists.drop("center").filter("other is null"), 1, None, 80).collect()}
    assert {(r.a, r.b) for r in pairs.collect()} == light | heavy
    small = lambda i: len(sets[i]).bit_length() <= 5
    assert any(small(i) and small(j) for i, j in links & light) and any(not small(i) for i, j in links & heavy)


def test_long_texts_and_extra_columns(spark):
    words = [f"w{k}" for k in range(30_000)]
    near = [*words[:15_000], "x", *words[15_001:]]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:20_000])), (4, " ".join(words).upper())]
    df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], "doc_id long, text string, node string, token string, component long")
    assert {r.doc_id: r.component_id for r in jaccard_join.join(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}


def test_driver_holds_small_broadcasts_and_drops_what_rounds_leave(spark, monkeypatch):
    from tidewheel.llm import shared

    assert shared.small_enough(65_000, 64, jaccard_join.SENT_BYTES) and not shared.small_enough(250_000, 64, jaccard_join.SENT_BYTES)
    calls = []
    monkeypatch.setattr(jaccard_join, "released", lambda s: (calls.append(1), shared.released(s)))
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join([*words, f"x{k}"])) for k in range(12)], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard_join.join(docs).collect()} == {0}
    assert len(calls) >= 2


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_texts_stay_where_they_are_whatever_their_number(spark):
    df = spark.createDataFrame([(k, " ".join(f"w{k % 5}x{j}" for j in range(40))) for k in range(20)], "doc_id long, text string").repartition(3)
    scanned = jaccard_join._scanned(df, "doc_id", "text", 5)
    members = jaccard_join._members(scanned.filter("n is null"))
    packed = jaccard_join._packed_tokens(df, "doc_id", "text", members, 10**9, jaccard_join.frequent_tokens(scanned), 5, 80, 8)
    assert _exchanges(packed) == 1  # that of the given repartition


def test_sets_whose_keys_are_equal_stay_apart(spark):
    texts = [" ".join(f"{x}{j}" for j in range(40)) for x in "ab"]
    df = spark.createDataFrame([(1, texts[0]), (2, texts[1]), (3, texts[0] + " z")], "doc_id long, text string")
    scanned = jaccard_join._scanned(df, "doc_id", "text", 5)
    members = {r["node"]: r for r in jaccard_join._members(scanned.filter("n is null")).collect()}
    same = members[1]["digest"][:8] + members[2]["digest"][8:]
    wanted = spark.createDataFrame([(1, members[1]["digest"], 36), (2, same, 36), (3, members[3]["digest"], 37)], "node long, digest binary, size int")
    packed = jaccard_join._packed_tokens(df, "doc_id", "text", wanted, 3, jaccard_join.frequent_tokens(scanned), 5, 80, 8)
    own = {r["node"]: {x["token"] for x in r["own"]} for r in jaccard_join._shared_tokens(packed, wanted, 80).filter("class is null").collect()}
    assert own[1] == own[2] == own[3] and own[1]


def test_sieve_loses_nothing(spark, monkeypatch):
    from tidewheel.llm import shared

    monkeypatch.setattr(shared, "MOST_BITS", shared.SIEVE_ROW * 2)
    ids = set(range(-9_000, 90_000, 7))
    rows = spark.range(-20_000, 100_000)
    passes = shared.sieve(spark.createDataFrame([(k,) for k in ids], "node long"), 10**9)
    inside, outside = ({r["id"] for r in passes(rows, "id", inside=x).collect()} for x in (True, False))
    assert ids <= inside and not inside & outside and len(inside) + len(outside) == 120_000
    assert len(inside - ids) < 0.2 * len(outside)


def _digits(df):
    """Decimal digits of the size that Spark estimates for a plan, beyond exabytes: a product of all that it joins."""
    said = df._jdf.queryExecution().optimizedPlan().stats().simpleString()
    return int((re.search(r"E\+(\d+) B", said) or (0, 0))[1])


def test_estimated_sizes_do_not_multiply_with_the_rounds(spark, monkeypatch):
    from tidewheel.llm.components import components

    chain = spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long")
    out = components(chain)
    assert _digits(out) < 1_000
    assert {(r["node"], r["component"]) for r in out.collect()} == {(k, 0) for k in range(301)}
    monkeypatch.setattr(jaccard_join, "GROWTH", 2)
    docs = corpus(2)
    out = jaccard_join.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert _digits(out) < 1_000
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == brute(docs)[0]


def test_pipeline_estimates_do_not_multiply_with_the_rounds(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(jaccard_join, "GROWTH", 2)
    real, joined = jaccard_join.join, []
    monkeypatch.setattr(jaccard_join, "join", lambda docs: joined.append(real(docs)) or joined[-1])
    docs = corpus(2)
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "")
    assert len(joined) == 1 and _digits(joined[0]) < 1_000
    assert {r["doc_id"] for r in out.collect()} == {i for i, (_, low) in brute(docs)[0].items() if i == low}
