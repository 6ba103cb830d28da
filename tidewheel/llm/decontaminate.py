"""Benchmark decontamination as a prefix-filtered set join.

Each benchmark item gives windows of ``window`` consecutive words (one window of all its words
when it has fewer).  A window seen as an ordered set of word shingles must be contained whole in
a document, so under any global order of shingles its prefix of length one is necessary: the
join key of a window is its *rarest* shingle, by frequency over all documents.

* The windows are a table, and so are the frequencies: documents are counted for the shingles that
  a sieve of the benchmark's lets through, and joined to the windows' own.
* Documents are scanned again for the chosen keys.  Each place found carries the words around it,
  as many as a window can reach, and joins the windows on the key.
* The key's place in its window fixes where the window would have to start (positional bound) and
  that it must fit in before the document's end (length bound); the words of the
  item-sized window are then compared.

A sieve is a bit table of bounded size that drops most places with no shingle of interest; what it
lets through by chance finds no partner in the join.  Shingles too many for one sieve are split by ranges of
their hashes, and documents are scanned once for each range.  Neither windows nor frequencies pass through the driver.

Defined edge cases: null or wordless text hits nothing; items without words (or null) have no
windows; an item without an id counts as an item and has no id in the list; equal windows of several items count for all of them; repeated document
rows are each answered; texts of any length are read whole; an empty table on either side gives no hits; extra columns are carried only when named
in ``keep`` and may have any names.
"""

from __future__ import annotations

import functools
import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.shared import hinted, pinned, slices, small_batches, trimmed, utf8
from tidewheel.llm.textscan import ALNUM, LOWER, mix, sequence_hashes, word_hashes, words

#: Bytes of text that are scanned at once.
SCAN_BYTES = 2 << 20
#: Words in a shingle that serves as a join key; of shorter windows all words are one shingle.
SHINGLE = 3
#: Bits of a sieve for each shingle, and of any sieve at most.
SIEVE_BITS, MOST_BITS = 16, 1 << 26
#: Ranges of hashes at most; a benchmark of more shingles than 16 sieves hold fills them further, and they let more places through.
RANGES = 16


#: The bits of a token that choose its range.
_RANGE_SHIFT = 40


def _scan(raw: np.ndarray, offsets: np.ndarray):
    lower = LOWER[raw]
    starts, ends, first = words(lower, offsets, ALNUM)
    return lower, starts, ends, first, word_hashes(lower, starts, ends)


def _shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where shingles of ``size`` words start that cross into no other text, and their tokens."""
    token = mix(sequence_hashes(hashes, size) + np.uint64(size))
    own = np.ones(len(token), bool)
    for k in range(1, size):
        cross = first[1:-1] - k
        own[cross[(cross >= 0) & (cross < len(token))]] = False
    at = np.flatnonzero(own)
    return at, token[at]


def windows(benchmark: DataFrame, window: int) -> DataFrame:
    """words (of a window), shingles (their tokens in order), size (words in a shingle) and items (structs of item_id)."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, SCAN_BYTES):
                lower, starts, ends, first, hashes = _scan(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                items, own, shingles, sizes = [], [], [], []
                for item, i, j in zip(batch.column(0)[a:b].to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                    text = [lower[x:y].tobytes().decode("utf-8") for x, y in zip(starts[i:j].tolist(), ends[i:j].tolist())]
                    size = min(SHINGLE, j - i)
                    token = mix(sequence_hashes(hashes[i:j], size) + np.uint64(size)).view(np.int64) if size else []
                    for at in range(max(1, j - i - window + 1) if size else 0):
                        items.append(item)
                        own.append(text[at : at + window])
                        shingles.append(token[at : at + min(window, j - i) - size + 1])
                        sizes.append(size)
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(own, pa.list_(pa.string())), pa.array(shingles, pa.list_(pa.int64())), pa.array(sizes, pa.int32())], ["item_id", "words", "shingles", "size"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text")).filter(F.col("text").isNotNull())
    found = items.mapInArrow(run, "item_id string, words array<string>, shingles array<bigint>, size int")
    return found.groupBy("words", "shingles", "size").agg(F.collect_set(F.struct("item_id")).alias("items"))


def sieves(tokens: DataFrame) -> list[tuple[int, int, np.ndarray]]:
    """Bit tables (64-bit words) with the bits of all tokens: one for each range of hashes, as (range, ranges, table)."""
    tokens = pinned(tokens)
    count = max(1, tokens.count())
    ranges = min(RANGES, max(1, -(-SIEVE_BITS * count // MOST_BITS)))
    bits = min(MOST_BITS, 1 << max(16, (SIEVE_BITS * -(-count // ranges) - 1).bit_length()))
    slot = tokens.select(F.col("token").bitwiseAND(bits - 1).alias("slot"), F.pmod(F.shiftrightunsigned("token", _RANGE_SHIFT), F.lit(ranges)).alias("range"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("slot").bitwiseAND(63).cast("int"))
    found = slot.groupBy("range", F.shiftright("slot", 6).alias("at")).agg(F.bit_or(one).alias("bits"))
    out = []
    for k in range(ranges):
        own, table = found.filter(F.col("range") == k).toArrow(), np.zeros(bits >> 6, np.uint64)
        table[own.column("at").to_numpy()] = own.column("bits").to_numpy().view(np.uint64)
        out.append((k, ranges, table))
    return out


def _sifted(token: np.ndarray, sieve: tuple[int, int, np.ndarray]) -> np.ndarray:
    own, ranges, table = sieve
    slot = token & np.uint64(len(table) * 64 - 1)
    held = table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)
    return np.flatnonzero(held if ranges == 1 else held.astype(bool) & ((token >> np.uint64(_RANGE_SHIFT)) % np.uint64(ranges) == own))


def _passes(make, docs: DataFrame, text: str, sizes: list[int], sieves_: list[tuple[int, int, np.ndarray]], *more) -> DataFrame:
    """What ``make`` finds with each sieve."""
    return functools.reduce(DataFrame.unionByName, [make(docs, text, sizes, sieve, *more) for sieve in sieves_])


def shingle_frequencies(docs: DataFrame, text: str, sizes: list[int], sieve: tuple[int, int, np.ndarray]) -> DataFrame:
    """token, n: how often the shingles that pass the sieve occur over all documents."""
    given = docs.sparkSession.sparkContext.broadcast(sieve)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            found = []
            for a, b in slices(offsets, SCAN_BYTES):
                *_, first, hashes = _scan(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for size in sizes:
                    token = _shingles(hashes, first, size)[1]
                    found.append(token[_sifted(token, given.value)])
            token, n = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n, pa.int64())], ["token", "n"])

    return docs.select(F.col(text)).mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def join_keys(found: DataFrame, docs: DataFrame, text: str, sizes: list[int]) -> DataFrame:
    """The windows with their rarest shingle as ``token``, and its ``place``; ties go to the smallest token, then the first place."""
    shingles = pinned(found.select(F.explode("shingles").alias("token")).distinct())
    counted = shingles.join(_passes(shingle_frequencies, docs, text, sizes, sieves(shingles)), "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))
    placed = found.select("words", "size", "items", F.posexplode("shingles").alias("place", "token")).join(counted, "token")
    rarest = placed.groupBy("words", "size").agg(F.min(F.struct("n", "token", "place")).alias("key"), F.first("items").alias("items"))
    return rarest.select("words", "size", "items", "key.token", "key.place")


def _occurrences(docs: DataFrame, text: str, sizes: list[int], sieve: tuple[int, int, np.ndarray], window: int) -> DataFrame:
    """sha, token, at, before, around: where sieved shingles stand (``at``) in a text, and the words around,
    ``before`` of them before it; a text that has the same words around it again gives one row."""
    given = docs.sparkSession.sparkContext.broadcast(sieve)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, SCAN_BYTES):
                lower, starts, ends, first, hashes = _scan(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                data = lower.tobytes()
                found: dict[tuple, list[int]] = defaultdict(list)
                for size in sizes:
                    at, token = _shingles(hashes, first, size)
                    own = _sifted(token, given.value)
                    reach = window - size if size == SHINGLE else 0
                    doc = np.searchsorted(first, at[own], side="right") - 1
                    low = np.maximum(at[own] - reach, first[doc])
                    high = np.minimum(at[own] + size + reach, first[doc + 1])
                    for p, t, d, i, j in zip(at[own].tolist(), token[own].view(np.int64).tolist(), doc.tolist(), low.tolist(), high.tolist()):
                        found[d, t, p - i, b" ".join([data[x:y] for x, y in zip(starts[i:j].tolist(), ends[i:j].tolist())])].append(p - int(first[d]))
                shas = batch.column(0)[a:b].to_pylist()
                yield pa.RecordBatch.from_arrays([
                    pa.array([shas[d] for d, *_ in found], pa.binary()), pa.array([t for _, t, *_ in found], pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64())),
                    pa.array([n for *_, n, _ in found], pa.int32()), pa.array([w.decode("utf-8") for *_, w in found], pa.string()),
                ], ["sha", "token", "at", "before", "around"])

    return docs.select("sha", F.col(text)).mapInArrow(run, "sha binary, token bigint, at array<bigint>, before int, around string")


def hits(docs: DataFrame, keys: DataFrame, text: str, sizes: list[int], window: int) -> DataFrame:
    """sha, spans (of words) and items of the texts that have a window."""
    places = _passes(_occurrences, docs, text, sizes, sieves(keys.select("token")), window)
    joined = places.join(hinted(keys, keys.count(), 64 + 16 * window), "token")
    begin = F.col("before") - F.col("place")
    here = F.slice(F.split("around", " "), F.greatest(begin, F.lit(0)) + 1, F.size("words"))
    joined = joined.filter((begin >= 0) & (here == F.col("words")))
    spans = F.transform("at", lambda p: F.struct((p - F.col("place")).alias("a"), (p - F.col("place") + F.size("words")).alias("b")))
    return joined.groupBy("sha").agg(F.flatten(F.collect_set(spans)).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def covered(spans: list[tuple[int, int]]) -> int:
    total, reached = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, reached))
        reached = max(reached, b)
    return total


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), window: int = 10) -> DataFrame:
    """``keep`` columns, n_words, hit_spans (word ranges), item_ids (sorted), n_hit, n_items, items_sha256, contaminated."""
    small_batches(docs.sparkSession)
    found = pinned(windows(benchmark, window))
    sizes = [r["size"] for r in found.select("size").distinct().orderBy("size").collect()]  # SHINGLE values at most
    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    shape = ", ".join(x for x in (own, "n_words bigint, hit_spans array<struct<a: bigint, b: bigint>>, item_ids array<string>, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean") if x)
    spans_type, names = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), [*keep, "n_words", "hit_spans", "item_ids", "n_hit", "n_items", "items_sha256", "contaminated"]
    source = docs.select(F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)).alias("sha"), F.col(f"`{text}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("own"))
    if sizes:
        keys = pinned(join_keys(found, source, "text", sizes))
        held = pinned(hits(source, keys, "text", sizes, window))
        total = held.agg(F.count(F.lit(1)).alias("n"), F.sum(16 * F.size("spans") + 32 * F.size("items")).alias("b")).first()
        source = source.join(hinted(held, total["n"], 64 + (total["b"] or 0) // max(1, total["n"])), "sha", "left")
    else:
        source = source.withColumns({"spans": F.array().cast("array<struct<a: bigint, b: bigint>>"), "items": F.array().cast("array<struct<item_id: string>>")})

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            n_words = []
            for a, b in slices(offsets, SCAN_BYTES):
                n_words.append(np.diff(words(LOWER[raw[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], ALNUM)[2]))
            spans = [sorted({(x["a"], x["b"]) for x in s or ()}) for s in batch.column(1).to_pylist()]
            items = [{x["item_id"] for x in s or ()} for s in batch.column(2).to_pylist()]
            ids = [sorted(x for x in s if x is not None) for s in items]
            hit = [covered(s) for s in spans]
            columns = [
                pa.array(np.concatenate(n_words or [np.zeros(0, np.int64)]), pa.int64()),
                pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], spans_type),
                pa.array(ids, pa.list_(pa.string())),
                pa.array(hit, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode("utf-8")).hexdigest() for x in ids], pa.string()),
                pa.array([n > 0 for n in hit], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], *columns], names)

    return source.select("text", "spans", "items", "own.*").mapInArrow(run, shape)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 10) -> DataFrame:
    """The rows of ``docs`` that no window of the benchmark occurs in, with all their columns, whatever their names."""
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return decontaminate(rows, benchmark, keep=("row",), window=window).filter("not contaminated").select("row.*")
