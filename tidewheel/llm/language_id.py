"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: every slot holds a bitmask with one bit per
language.  An n-gram is hashed to two slots, and the bitwise AND of their masks answers, for all
languages at once, which of them contain it.  Popcounts per language over the n-grams of a text,
corrected for each language's own false-positive rate, decide.

A mask has as many 64-bit words as the languages need.

Fitting uses a bounded sample of labelled rows (``sample_rows`` for each language, chosen by a
hash of the id); the filter has a fixed number of slots, or more where the n-grams of many languages need them.  Prediction reads every whole text and
nothing else.  An n-gram counts as contained in a language when its share there is at least
``share`` of its largest share in any language, so stray foreign passages set no bits.

Defined edge cases: null text or text without a letter is ``und`` with score 0; a text none of
whose n-grams is known, or equal counts, goes to the first language in alphabetical order (score
0 if nothing is known); without training rows everything is ``und``; a null id counts as the
empty string; repeated rows are each answered; extra columns have no influence.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.shared import pinned, trimmed
from tidewheel.llm.textscan import mix

#: Labelled rows of each language in the fitting sample (expected number; rows are chosen by hash).
SAMPLE_ROWS = 2000
#: Slots of the filter at least, a power of two; it grows to ``SLOTS_A_GRAM`` for each n-gram, up to ``MOST_SLOTS``.
SLOTS = 1 << 19
SLOTS_A_GRAM, MOST_SLOTS = 4, 1 << 23
SIZES = (3, 4)
SHARE = 0.25
LEAST = 3
SCAN_CHARS = 1 << 20
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTER[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, the text that each belongs to, and whether a text has a letter.

    Texts are lower-cased; what is no letter becomes one blank; n-grams reach over no inner blank.
    """
    lowered = [f" {t.lower()} " for t in texts]
    ends = np.cumsum([len(t) for t in lowered]) if lowered else np.zeros(0, np.int64)
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    lettered = np.bincount(owner[letter], minlength=len(texts)) > 0 if len(texts) else np.zeros(0, bool)
    keep = letter | np.concatenate([[True], letter[:-1]])[: len(letter)]  # runs of blanks shrink to one
    code, letter, owner = np.where(letter, code, 32)[keep].astype(np.uint64), letter[keep], owner[keep]
    hashed, of = [], []
    for size in SIZES:
        n = len(code) - size + 1
        if n <= 0:
            continue
        key = np.full(n, size, np.uint64)
        inner = np.ones(n, bool)
        for k in range(size):
            key = key << np.uint64(13) ^ key >> np.uint64(51) ^ code[k : k + n] * np.uint64(0x9E3779B97F4A7C15)
            if 0 < k < size - 1:
                inner &= letter[k : k + n]
        inner &= owner[:n] == owner[size - 1 :]
        hashed.append(mix(key[inner]))
        of.append(owner[:n][inner])
    return np.concatenate(hashed or [np.zeros(0, np.uint64)]), np.concatenate(of or [np.zeros(0, np.int64)]), lettered


def _parts(texts: list[str]) -> Iterator[list[str]]:
    part, held = [], 0
    for t in texts:
        if part and held + len(t) > SCAN_CHARS:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part


@dataclass
class Filter:
    """Languages in alphabetical order, the slots' masks (a column for each 64 languages), and each language's false-positive rate."""

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray

    def contained(self, hashed: np.ndarray) -> np.ndarray:
        """For each n-gram the mask of all languages that contain it."""
        slots = np.uint64(len(self.masks) - 1)
        return self.masks[(hashed & slots).astype(np.int64)] & self.masks[(hashed >> np.uint64(32) & slots).astype(np.int64)]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        langs, scores = [], []
        for part in _parts(texts):
            hashed, owner, lettered = grams(part)
            masks, total = self.contained(hashed), np.bincount(owner, minlength=len(part))
            has = lambda k: (masks[:, k // 64] >> masks.dtype.type(k % 64) & masks.dtype.type(1)).astype(bool)
            count = np.stack([np.bincount(owner[has(k)], minlength=len(part)) for k in range(len(self.languages))])
            right = np.maximum(0, (count - total * self.false_rate[:, None]) / (1 - np.minimum(self.false_rate[:, None], 0.999)))
            best, whole = right.argmax(axis=0), right.sum(axis=0)
            top = right.max(axis=0)
            for k in range(len(part)):
                known = bool(lettered[k])
                langs.append(self.languages[best[k]] if known else "und")
                scores.append(float(top[k] / whole[k]) if known and whole[k] > 0 else 0.0)
        return langs, scores


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, slots: int = SLOTS, share: float = SHARE) -> Filter:
    """Fit the filter on a bounded sample of the rows of ``labelled`` that have a text and a language."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(doc_id).cast("string")).alias("draw")).filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Filter([], np.zeros((1, 1), np.uint8), np.zeros(0))
    ceiling = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, int(min(1.0, sample_rows / n) * 2**31))])
    sample = rows.filter(F.pmod("draw", F.lit(2**31)) < ceiling[F.col("lang")])
    bit = {name: k for k, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.array([bit[x] for x in batch.column(1).to_pylist()], np.int64)
            texts = batch.column(0).to_pylist()
            for k in np.unique(of):
                mine = [grams(p)[0] for p in _parts([texts[i] for i in np.flatnonzero(of == k)])]
                gram, n = np.unique(np.concatenate(mine), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), k)), pa.array(gram.view(np.int64)), pa.array(n)], ["bit", "gram", "n"])

    counted = sample.select("text", "lang").mapInArrow(count, "bit bigint, gram bigint, n bigint").groupBy("bit", "gram").agg(F.sum("n").alias("n"))
    total = F.create_map(*[F.lit(x) for r in counted.groupBy("bit").agg(F.sum("n").alias("n")).collect() for x in (r["bit"], float(r["n"]))])
    shares = counted.withColumn("p", F.col("n") / total[F.col("bit")]).groupBy("gram").agg(F.max("p").alias("top"), F.collect_list(F.struct("bit", "p", "n")).alias("of"))
    own = F.filter("of", lambda x: (x["p"] >= F.col("top") * share) & (x["n"] >= LEAST))
    marked = pinned(shares.select("gram", F.explode(own).alias("x")).select("gram", F.floor(F.col("x.bit") / 64).cast("int").alias("word"), F.pmod("x.bit", F.lit(64)).cast("int").alias("bit")))
    while slots < MOST_SLOTS and slots < SLOTS_A_GRAM * marked.agg(F.approx_count_distinct("gram").alias("n")).first()["n"]:
        slots *= 2
    places = F.explode(F.array(F.col("gram").bitwiseAND(slots - 1), F.shiftrightunsigned("gram", 32).bitwiseAND(slots - 1)))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))
    filled = marked.select("word", one.alias("mask"), places.alias("slot")).groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    kind = next((t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(languages) <= bits), np.uint64)
    masks = np.zeros((slots, (len(languages) + 63) // 64), kind)
    masks[filled.column("slot").to_numpy(), filled.column("word").to_numpy()] = filled.column("mask").to_numpy().view(np.uint64).astype(kind)
    fill = np.array([np.count_nonzero(masks[:, k // 64] >> kind(k % 64) & kind(1)) / slots for k in range(len(languages))])
    return Filter(languages, masks, fill**2)


def predict(docs: DataFrame, fitted: Filter, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score, from the whole text alone."""
    given = docs.sparkSession.sparkContext.broadcast(fitted)
    names = [*keep, "lang_pred", "score"]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = given.value.predict([t or "" for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(F.col(text).alias("__text"), *[F.col(c) for c in keep]).mapInArrow(run, kinds + "lang_pred string, score double")
