"""Spelling variants by a symmetric-delete join.

* Each task counts the words of its texts and passes on one count a word; counts meet once.
* Every word of the vocabulary emits the hash of itself and of its distinct single deletions, each with the places
  that give it.  Keys are 64-bit numbers read from prefix sums, so a word of n characters costs n rows of
  fixed size, whatever n is.
* Words that share a key meet in an equi-join.  Two are near if one of them is the key itself (the other has a
  character more) or if they lost a character at the same place (it was replaced); others that only share
  a key are dropped inside the join.  What is left is verified on the words themselves.
* Near words are aggregated to counts and to the most frequent one, a word's form.  Roots follow forms by
  doubling joins over the words that have a form.  Along forms counts grow tenfold, so few rounds suffice.

A key is shared by the words that have one character more and by none else, so by as many as places times letters,
however often they occur; counts of frequent words are aggregated before any shuffle.

Defined edge cases: null texts have no words; a null document id counts as an empty one; repeated rows count each; texts
and words of any length are read whole; ties of forms go to the smallest word in code-point order; an empty table
has no words; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.shared import pinned, trimmed
from tidewheel.llm.textscan import _BASE, _INVERSE, _powers, mix

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Different words that a task counts before it passes them on, and characters whose deletions are made at once.
HELD, MADE = 1 << 18, 1 << 18
_ASCII_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 256))


def slipped(doc: str) -> Callable[[str], str]:
    """How document ``doc`` spells a run: of each 31 runs, by a checksum, one misses a letter."""
    start = zlib.crc32(f"{doc}:".encode())

    def spelt(run: str) -> str:
        h = zlib.crc32(run.encode("utf-8"), start)
        if h % 31:
            return run
        gone = h % len(run)
        return run[:gone] + run[gone + 1 :]

    return spelt


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_chars: int = 7, least_count: int = 2, spelt: Callable[[str], Callable[[str], str]] | None = None) -> DataFrame:
    """word, n: the words of ``least_chars`` code points or more that occur ``least_count`` times or more.

    Words are runs of letters with only A-Z lower-cased; ``spelt(doc)(run)`` may change
    a document's runs, but never lengthens one.
    """

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = value.as_py()
                if not value:
                    continue
                lower = value.encode("utf-8").translate(_ASCII_LOWER).decode("utf-8")
                own = Counter(RUN.findall(lower))
                speller = None if spelt is None else spelt(doc or "")
                for word, n in own.items():
                    if len(word) >= least_chars:
                        word = speller(word) if speller else word
                        if len(word) >= least_chars:
                            counts[word] += n
                if len(counts) > HELD:
                    yield _counted(counts)
                    counts = Counter()
        yield _counted(counts)

    rows = docs.select(F.col(f"`{doc_id}`").cast("string").alias("doc"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _counted(counts: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def deletions(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all words: which word each is of, its hash, and the first and last place whose deletion gives it (-1: the word itself)."""
    size = np.array([len(w) for w in words], np.int64)
    char = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    begin = np.cumsum(size) - size
    of = np.repeat(np.arange(len(words)), size)
    sums = np.zeros(len(char) + 1, np.uint64)
    np.cumsum((char.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(char)), out=sums[1:])
    inverse = _powers(_INVERSE, len(char) + 2)
    low, high = sums[begin], sums[begin + size]
    new = np.ones(len(char), bool)  # places whose character is not the one before
    new[1:] = (char[1:] != char[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(char)) - 1
    own = of[at]
    # What stands behind the lost character moves one place forward.
    left = (sums[at] - low[own]) + (high[own] - sums[at + 1]) * inverse[1]
    gone = mix(left * inverse[begin[own]] ^ (size[own] - 1).astype(np.uint64))
    whole = mix((high - low) * inverse[begin] ^ size.astype(np.uint64))
    none = np.full(len(words), -1, np.int64)
    return np.concatenate([np.arange(len(words)), own]), np.concatenate([whole, gone]), np.concatenate([none, at - begin[own]]), np.concatenate([none, last - begin[own]])


def keys(words: DataFrame) -> DataFrame:
    """id, key, low, high: each word's own hash and those of its distinct single deletions."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            first = 0
            while first < len(own):
                last, chars = first + 1, len(own[first])
                while last < len(own) and chars + len(own[last]) <= MADE:
                    chars += len(own[last])
                    last += 1
                of, key, low, high = deletions(own[first:last])
                yield pa.RecordBatch.from_arrays([pa.array(ids[first:last][of]), pa.array(key.view(np.int64)), pa.array(low, pa.int32()), pa.array(high, pa.int32())], ["id", "key", "low", "high"])
                first = last

    return words.select("id", "word").mapInArrow(run, "id bigint, key bigint, low int, high int")


def near(words: DataFrame) -> DataFrame:
    """a, b (ids, a < b) and their words and counts: the pairs of ``words`` (id, word, n) at exactly one edit."""
    every = keys(words)
    a, b = (every.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "low", "high")]) for side in "ab")
    inserted = (F.col("low_a") < 0) | (F.col("low_b") < 0)
    replaced = (F.col("low_a") <= F.col("high_b")) & (F.col("low_b") <= F.col("high_a"))
    pairs = a.join(b, "key").filter((F.col("id_a") < F.col("id_b")) & (inserted | replaced)).select("id_a", "id_b")
    for side in "ab":
        pairs = pairs.join(words.select(*[F.col(c).alias(f"{c}_{side}") for c in ("id", "word", "n")]), f"id_{side}")
    return pairs.filter(F.levenshtein("word_a", "word_b", 1) == 1)


def variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """word, n, form, form_n, n_near and root of every row of ``words`` (word, n).

    A word's form is its near word of largest n, where that is at least ``factor`` (2 or more) times its own.
    """
    own = pinned(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    pairs = pinned(near(own))
    both = pairs.select(F.col("id_a").alias("id"), F.col("word_b").alias("other"), F.col("n_b").alias("m")).unionByName(pairs.select(F.col("id_b").alias("id"), F.col("word_a").alias("other"), F.col("n_a").alias("m")))
    best = both.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    joined = own.join(best, "id", "left")
    has = F.coalesce(-F.col("best.m") >= factor * F.col("n"), F.lit(False))
    formed = pinned(joined.select("word", "n", F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.m")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near")))
    roots = rooted(formed.filter("form is not null").select("word", F.col("form").alias("root")))
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def rooted(links: DataFrame) -> DataFrame:
    """word, root: the last word that ``links`` (word, root; a forest) lead to, by doubling."""
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = pinned(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = joined.select("word", "root")
        if not joined.filter("moved").head(1):
            return links


def grouped(docs: DataFrame, **options) -> DataFrame:
    """The variants of the vocabulary of ``docs``."""
    return variants(vocabulary(docs, **options))
