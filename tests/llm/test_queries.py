"""The registered queries on the small test tables, and the pipeline against brute force."""

import hashlib
import random

import pytest
import test_decontaminate
import test_jaccard_join
import tiktoken
from compare import same
from conftest import DATA

from tidewheel.llm import queries
from tidewheel.llm.bpe_replay import Vocabulary

ORACLES = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    out = queries.queries()[name](spark, DATA)
    if name in ORACLES:
        same(out, duck.sql(ORACLES[name]))
    else:
        table = "pages" if name.split("_")[0] in ("op1", "op8") else "documents"
        assert out.count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


def test_pipeline(spark, duck):
    import corpus_pipeline
    import public_tokenizers as public

    docs = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    kept = [i for i, ok in duck.sql(f"SELECT doc_id, kept FROM ({ORACLES['op5_quality_rules']})").fetchall() if ok]
    components, _, _ = test_jaccard_join.brute([(i, docs[i]) for i in sorted(kept)])
    kept = [i for i in sorted(kept) if components[i][1] == i]
    texts = remaining([docs[i] for i in kept])
    items = duck.sql("SELECT item_id, text FROM benchmark").fetchall()
    hits = test_decontaminate.brute(list(zip(kept, texts)), items)
    vocabulary = Vocabulary.load(public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    want = {}
    for i, t in zip(kept, texts):
        if not hits[i][1]:
            ids = library.encode_ordinary(t)
            want[i] = (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want and len(want) > 20
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_take_odd_rows(spark):
    import corpus_pipeline

    rng = random.Random(7)
    text = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    passage, item = text(60), spark.read.parquet(f"{DATA}/benchmark.parquet").filter("length(text) > 80").first().text
    plain, copied, shared, hit, long = text(80), text(90), text(70), f"{text(20)} {item} {text(20)}", text(40_000)
    rows = [(1, plain), (2, copied), (3, copied), (None, copied), (None, text(50)), (4, shared), (4, shared), (5, None), (6, ""), (7, f"{text(40)} {passage} {text(30)}"), (8, f"{text(40)} {passage} {text(30)}"), (9, hit), (10, long)]
    shape = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, sha string, spans string, `row` string, node string, token string, contaminated string, own string"
    docs = spark.createDataFrame([(i, t, None if i == 1 else "en", None if i == 2 else "s", 1, *"abcdefghi") for i, t in rows], shape)
    ids = lambda df: sorted((r.doc_id or 0 for r in df.collect()))
    stages = dict(corpus_pipeline.STAGES)
    out = stages["quality_rules"](spark, docs, DATA)
    assert out.columns == docs.columns and ids(out) == [0, 0, 1, 2, 3, 4, 4, 7, 8, 9, 10]
    out = stages["near_duplicates"](spark, docs, DATA)
    assert out.columns == docs.columns and ids(out) == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10]
    whole = stages["repeated_passages"](spark, docs, DATA)
    assert whole.columns == docs.columns
    got = {r.doc_id: r.text for r in whole.filter("doc_id is not null").collect()}
    assert got[1] == plain and got[2] == got[3] == got[4] == got[6] == "" and got[5] is None and got[10] == long
    assert passage not in got[7] and got[7][:200] == dict(rows)[7][:200]
    out = stages["decontamination"](spark, docs, DATA)
    assert out.columns == docs.columns and ids(out) == sorted(i or 0 for i, _ in rows if i != 9)
    assert [tuple(r)[5:] for r in out.collect()] == [tuple("abcdefghi")] * (len(rows) - 1)
    out = stages["encoding"](spark, docs, DATA)
    assert out.count() == len(rows) and [r.n_tokens for r in out.filter("doc_id in (5, 6)").collect()] == [0, 0]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0, name


def remaining(texts, window=200):
    """Texts without the characters all of whose bytes repeat."""
    from collections import Counter

    raw = [t.encode() for t in texts]
    seen = Counter(r[i : i + window] for r in raw for i in range(len(r) - window + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        own, at = [], 0
        for c in r.decode():
            n = len(c.encode())
            if not all(gone[at : at + n]):
                own.append(c)
            at += n
        out.append("".join(own))
    return out




def test_near_duplicates_leave_texts_where_they_are(spark, monkeypatch):
    import corpus_pipeline
    from tidewheel.llm import jaccard_join, shared

    monkeypatch.setattr(jaccard_join, "SENT_BYTES", 0)  # as for many documents
    monkeypatch.setattr(shared, "MOST_BITS", 64, raising=False)  # many of those that stay pass the sieve by chance
    texts = [" ".join(f"t{k}w{j}" for j in range(30)) for k in range(40)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, t + " more") for k, t in enumerate(texts[:15])] + [(200, None), (201, "")]
    rows += [(7, texts[7]), (None, texts[3]), (None, "alone")]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "SortMergeJoin" in x and "LeftSemi" in x]
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in out.collect())
    assert got == sorted([(-1, "alone"), (200, ""), (201, ""), *enumerate(texts)])
