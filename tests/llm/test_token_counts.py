"""Counts against the sentencepiece library, set to its unigram mode.

The library adds single floats; the lone blank's score of -1e9 would swallow the others there, so
the test's model has -31000 in its place and all sums are exact in either precision.
"""

import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from tidewheel.llm.token_counts import Vocabulary, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def varint(data, at):
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def unigram_model():
    """The model with trainer_spec.model_type (field 2, field 3) set from BPE to UNIGRAM."""
    data, at = bytearray(open(PATH, "rb").read()), 0
    while at < len(data):
        key, at = varint(data, at)
        size, start = varint(data, at) if key & 7 == 2 else (0, at)
        if key >> 3 == 2:
            inner = start
            while inner < start + size:
                tag, inner = varint(data, inner)
                if tag >> 3 == 3 and tag & 7 == 0:
                    assert data[inner] == 2
                    data[inner] = 1
                    blank = data.index(b"\x0a\x03\xe2\x96\x81\x15") + 6
                    data[blank : blank + 4] = struct.pack("<f", -31000.0)
                    return bytes(data)
                if tag & 7 == 2:
                    n, inner = varint(data, inner)
                    inner += n
                elif tag & 7 == 0:
                    _, inner = varint(data, inner)
                else:
                    inner += 4 if tag & 7 == 5 else 8
        at = start + size
    raise AssertionError


@pytest.fixture(scope="module")
def model(tmp_path_factory):
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(unigram_model())
    return str(path)


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_file=model)


def texts():
    rng = random.Random(7)
    out = ["", " ", "a", "  two  blanks ", "Hello world", "naïve café", "漢字 and 😀!", "tab\there\n\nlines", "aaaaaaaaaaaaaaaa", "▁ mark"]
    letters = "etaoin shrdlu.,éß漢😀\n  "
    return out + ["".join(rng.choices(letters, k=rng.randrange(1, 120))) for _ in range(400)]


def test_against_library(library, model):
    vocabulary = Vocabulary.load(model)
    for t in texts():
        assert vocabulary.count(t)[0] == len(library.encode(t)), t


def test_against_all_paths():
    pieces = {"▁": -1.0, "a": -2.0, "b": -2.0, "ab": -4.0, "ba": -3.0, "▁a": -3.0, "aba": -6.0}
    v = Vocabulary(pieces, bytes_for_unknown=False)

    def best(word):
        # Paths in the library's order of starts; the first best stays.
        score = [(0.0, 0)] + [None] * len(word)
        for i in range(len(word)):
            for n in range(1, len(word) - i + 1):
                own = pieces.get(word[i : i + n], v.unknown if n == 1 and word[i] not in pieces else None)
                if own is not None and (score[i + n] is None or score[i][0] + own > score[i + n][0]):
                    score[i + n] = score[i][0] + own, score[i][1] + 1
        return score[-1][::-1]

    rng = random.Random(3)
    for _ in range(500):
        word = "▁" + "".join(rng.choices("abz", k=rng.randrange(1, 9)))
        assert v.best(word) == best(word)


def test_query(spark, library, model):
    rows = [(k, t) for k, t in enumerate([None, "", *texts()[:50]])]
    got = {r.doc_id: r.n_tokens for r in token_counts(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {k: len(library.encode(t or "")) for k, t in rows}
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_repeated_rows_long_texts_and_extra_columns(spark, library, model):
    own = [t for t in texts() if t]
    long = " ".join(own * 40)
    rows = [(1, own[20], "x", "y"), (1, own[20], "x", "y"), (None, long, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, score string")
    got = sorted(((r.doc_id, r.n_tokens) for r in token_counts(df, model).collect()), key=str)
    assert len(long) > 500_000 and got == sorted([(i, len(library.encode(t))) for i, t, _, _ in rows], key=str)
