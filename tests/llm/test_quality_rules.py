"""Metrics, sketches and fences."""

import random

import duckdb
from compare import same
from pyspark.sql import functions as F

from tidewheel.llm import quality_rules, queries


def brute_repeat(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 5)}
    return len(hit)


def corpus():
    rng = random.Random(11)
    rows = []
    for k in range(260):
        words = [rng.choice(["tree", "house", "of", "water", "a", "étang", "b"]) for _ in range(rng.choice([0, 3, 9, 12, 60, 150]))]
        if k % 13 == 0:
            words = [w + "###" for w in words]
        if k % 17 == 0:
            words = words[:6] * 9
        text = "".join(w + rng.choice([" ", "  ", "\n", "\t", "\n\n"]) for w in words)
        rows.append((k, None if k == 5 else text, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s0", "s1", None]), 1))
    return rows + rows[:3]


def test_against_sql(spark, tmp_path):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(queries.op5_quality_rules(spark, str(tmp_path)), con.sql(queries.OP5_SQL))


def test_repeat_words(spark):
    rows = corpus()
    got = {r.row.doc_id: r.n_repeat_words for r in quality_rules.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert got == {k: brute_repeat((t or "").split()) for k, t, *_ in rows}


def test_sketches_merge(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    measures = quality_rules.measured(df)
    whole = quality_rules.merged(quality_rules.sketches(measures), "lang")
    halves = quality_rules.sketches(measures.filter("row.doc_id % 2 = 0")).unionByName(quality_rules.sketches(measures.filter("row.doc_id % 2 = 1")))
    key = lambda d: sorted(map(tuple, d.select("lang", "metric", "bucket", "n").collect()), key=str)
    assert key(whole) == key(quality_rules.merged(halves, "lang"))
    spread = spark.range(1, 100_000, 7).withColumn("b", quality_rules.bucket(F.col("id")))
    assert spread.filter("b > id or b < id - id / 31.0").count() == 0


def test_clean_documents_stay(spark):
    rng = random.Random(2)
    clean = [(k, " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(rng.randrange(12, 300))) + ".", "en", "s", 1) for k in range(300)]
    dirty = [(1000 + k, " ".join("".join(rng.choices("abcd", k=4)) + "%%%" for _ in range(80)), "en", "s", 1) for k in range(20)]
    out = quality_rules.judge(spark.createDataFrame(clean + dirty, "doc_id long, text string, lang string, source string, n_chars long"))
    assert out.filter("doc_id < 1000 and not kept").count() == 0 and out.filter("doc_id >= 1000 and kept").count() == 0


def test_a_few_symbols_or_repeated_lines_are_no_fault(spark):
    rng = random.Random(12)
    text = lambda: ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(400)]
    rows = []
    for k in range(400):
        words = text()
        if k % 5 == 0:  # a fifth has four dollar signs
            for at in (3, 99, 200, 311):
                words[at] = "$" + words[at]
        lines = [" ".join(words[i : i + 10]) for i in range(0, 400, 10)]
        if k % 7 == 0:  # and a seventh a line twice
            lines[20] = lines[3]
        rows.append((k, "\n".join(lines), "en", "s", 1))
    junk = [(1000 + k, " ".join(w + "%%%" for w in text()), "en", "s", 1) for k in range(20)] + [(1100 + k, "\n".join([" ".join(text()[:10])] * 3 + [" ".join(text()[:10]) for _ in range(7)]), "en", "s", 1) for k in range(20)]
    out = quality_rules.judge(spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string, n_chars long"))
    assert out.filter("doc_id < 1000 and not kept").count() == 0 and out.filter("doc_id between 1000 and 1099 and kept").count() == 0


def test_groups_have_fences_of_their_own(spark):
    rng = random.Random(4)
    rows = []
    for k in range(900):
        words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(100)]
        source = ("plain", "code", "few")[k % 3] if k < 880 else "few"
        if source == "code" and k % 2:  # half of this source's documents have some symbols
            words = [w + "#" * (i % 8 == 0) for i, w in enumerate(words)]
        if source == "plain" and k % 30 == 0:
            words = [w + "#" * (i % 4 == 0) for i, w in enumerate(words)]
        rows.append((k, " ".join(words), "en", source, 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    fences = {r.of_source: r for r in quality_rules.fences(quality_rules.sketches(quality_rules.measured(df))).collect()}
    assert fences["code"].symbols_75 > fences["few"].symbols_75 and fences["plain"].symbols_mid > fences["code"].symbols_mid
    kept = {r.doc_id for r in quality_rules.judge(df).filter("kept").collect()}
    symbols = lambda source: {k for k, t, _, s, _ in rows if s == source and "#" in t}
    assert symbols("code") <= kept and not symbols("plain") & kept


def test_a_document_right_at_a_fence_stays(spark):
    measures = quality_rules.measured(spark.createDataFrame([(1, " ".join(["abcde"] * 12) + " " + "#" * 3, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long"))
    value = measures.select(quality_rules.rule_metrics()["symbols"].alias("v")).first().v
    for at, kept in ((value, True), (value - 1, False)):
        wide = {f"{m}_{c}": 10**6 if m != "symbols" else 0 for m in (*quality_rules.SHARES, "words") for c in (25, 50, 75, "mid")} | {"symbols_75": at, "symbols_25": at, "words_50": 1}
        fence = spark.createDataFrame([("en", "s", *map(float, wide.values()))], ["of_lang", "of_source", *wide])
        row = quality_rules.judged(measures.withColumn("base_failed", F.lit(False)), fence).first()
        assert row.kept == kept


def test_edges(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    assert quality_rules.judge(spark.createDataFrame([], shape)).count() == 0
    text = " ".join(f"word{k}" for k in range(20))
    rows = [(None, None, None, None, 7.0, "x", "y"), (1, text, "en", "s", 7.0, "x", "y"), (1, text, "en", "s", 7.0, "x", "y"), (2, text + " " + "z" * 300_000, "en", "s", 7.0, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, words_50 double, kept string, n_words string")
    out = quality_rules.judge(df)
    assert out.columns == [*df.columns, *(f"_{c}" if c in ("kept", "n_words") else c for c in quality_rules.ADDED)]
    assert sorted(map(tuple, out.select("doc_id", "kept", "n_words", "_n_words", "words_50").collect()), key=str) == [(1, "x", "y", 20, 7.0), (1, "x", "y", 20, 7.0), (2, "x", "y", 21, 7.0), (None, "x", "y", 0, 7.0)]
    assert quality_rules.filtered(df).columns == df.columns
