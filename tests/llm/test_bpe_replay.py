"""Ids and round trips against the tiktoken library."""

import base64
import hashlib
import random

import public_tokenizers as public
import pytest
import tiktoken

from tidewheel.llm.bpe_replay import Vocabulary, decode, digests, encode, encode_shard

PATH = public.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    letters = "aab bcsst  e'\n\t\x0b.é漢😀12"
    out = [None, "", "a" * 3000, " " * 2000 + "x", "ab" * 2000, "\n" * 700, "don't we'll I'm", "<|endoftext|>"]
    out += ["".join(rng.choices(letters, k=rng.randrange(300))) for _ in range(500)]
    return out + [f"a{chr(c)}b {chr(c)}{chr(c)}1" for c in range(0, 0x3100, 3)]


def test_shards(library):
    vocabulary = Vocabulary.load(PATH, public.PATTERN)
    own = texts()
    for shard in (own, own[::2], own[:1], []):
        for t, ids in zip(shard, encode_shard(shard, vocabulary), strict=True):
            assert ids.tolist() == library.encode_ordinary(t or ""), t
            assert decode(ids, vocabulary) == (t or "").encode()


def test_lower_ranks_uncovered_by_a_merge(tmp_path):
    """After "ab" the pair "ab" + "c" has a lower rank than "ab" itself."""
    tokens = [bytes([b]) for b in range(256)]
    tokens += [b"abc", b"ab", b"ca", b"bca"]
    path = tmp_path / "v.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % k for k, t in enumerate(tokens)))
    library = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    vocabulary = Vocabulary(str(path), r"\S+")
    rng = random.Random(2)
    own = ["".join(rng.choices("abc", k=rng.randrange(1, 30))) for _ in range(300)]
    for t, ids in zip(own, encode_shard(own, vocabulary)):
        assert ids.tolist() == library.encode_ordinary(t), t


def test_operator(spark, library):
    own = texts()[:60]
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(own)], "doc_id long, text string, token_ids long").repartition(3)
    for r in digests(df, PATH, public.PATTERN).collect():
        ids = library.encode_ordinary(own[r.doc_id] or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((own[r.doc_id] or "").encode()).hexdigest())
    for r in encode(df, PATH, public.PATTERN).collect():
        assert r.token_ids == library.encode_ordinary(own[r.doc_id] or "") and bytes(r.decoded) == (own[r.doc_id] or "").encode()
    assert digests(df.limit(0), PATH, public.PATTERN).count() == 0


def test_repeated_rows_and_texts_over_a_shard(spark, library, monkeypatch):
    from tidewheel.llm import bpe_replay

    rng = random.Random(6)
    long = " ".join("".join(rng.choices("etaoinshr", k=rng.randrange(1, 9))) for _ in range(900_000))
    assert len(long) > bpe_replay.SHARD_BYTES
    rows = [(1, "again and again", "x"), (1, "again and again", "x"), (None, "no id", "x"), (2, long, "x"), (3, None, "x")]
    got = sorted(((r.doc_id, r.n_tokens, r.decoded_sha256) for r in digests(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH, public.PATTERN).collect()), key=str)
    assert got == sorted([(i, len(library.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows], key=str)
