"""Removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

A byte goes when it is covered by a string of ``WINDOW`` bytes that also starts anywhere else in
the corpus.  Suffixes are dealt out by content so that equal windows always meet in one task:

1. Equal texts are one class; texts with a copy, long enough, are repeated whole.
2. Every window of WINDOW bytes chooses its smallest KMER-byte hash (leftmost on ties).  A run of
   windows with one choice is a *segment*.  Equal windows make equal choices, so a choice that
   occurs in one place only is settled; only the other segments move on, dealt by their choice.
   A choice whose segments are too many for one task is dealt further by ever larger pieces of
   content around it, down to single windows if need be; those are counted by Spark and not merged.
3. In a task, segments form shards.  Each shard's suffix array gives its Burrows-Wheeler
   transform over 8-byte symbols.  The transforms are merged by refining the interleave: a round
   distributes the merged order stably by the transform's symbols, so after k rounds all suffixes
   are in the order of their first k symbols without comparing or re-sorting them.  Block borders
   are carried along and are the common prefixes; blocks of one entry are settled and leave.
   After WINDOW / 8 rounds, a block of two or more windows is a repeated interval.

Defined edge cases: null text is empty; texts shorter than WINDOW have no window; repeated rows
are copies of each other; matches never cross texts; texts of any length are read whole; an empty table gives no rows; extra columns
of any name are carried by ``remove`` and ignored by ``digests``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.llm.shared import hinted, pinned, slices, small_batches, trimmed, unused, utf8, written
from tidewheel.llm.textscan import prefix_sums, span_hashes

WINDOW = 200
KMER = 64
SYMBOL = 8
SCAN_BYTES = 1 << 20
#: Bytes of segments in one merge, of the segments of one deal in it, and in one of its shards.
#: A merge takes about 100 times its bytes of memory.
MERGE_BYTES = 1 << 20
GROUP_BYTES = 1 << 20
SHARD_BYTES = 1 << 18
#: Rows with one window above which it is joined by broadcast, so that they stay where they lie.
COMMON = 10_000


# ---------------------------------------------------------------- segments


def choices(raw: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Segments of the texts: text, first window's start, windows, place and hash of the choice."""
    none = np.zeros(0, np.int64)
    n = len(raw)
    if n < window:
        return none, none, none, none, none.astype(np.uint64)
    kmer = min(KMER, window)
    at = np.arange(n - kmer + 1)
    hashes = span_hashes(prefix_sums(raw), at, at + kmer)
    key = (hashes >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    span, size = window - kmer + 1, 1
    while size * 2 <= span:
        key, size = np.minimum(key[:-size], key[size:]), size * 2
    if size < span:
        key = np.minimum(key[: len(key) - (span - size)], key[span - size :])
    place = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(n - window + 2, np.int32)  # windows that cross no text border
    first, last = offsets[:-1], offsets[1:] - window + 1
    long = last > first
    np.add.at(inside, first[long], 1)
    np.add.at(inside, last[long], -1)
    own = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
    if not len(own):
        return none, none, none, none, none.astype(np.uint64)
    place = place[own]
    starts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (own[1:] != own[:-1] + 1)]))
    count = np.diff(np.concatenate([starts, [len(own)]]))
    begin, place = own[starts], place[starts]
    text = np.searchsorted(offsets, begin, side="right") - 1
    return text, begin, count, place, hashes[place]


def _choice_rows(docs: DataFrame, text: str) -> DataFrame:
    """choice, key (hash of the text), again: a text chooses it in more places than one."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            key = batch.column(0).to_numpy()
            for a, b in slices(offsets, SCAN_BYTES):
                of, _, _, _, choice = choices(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                order = np.lexsort((choice, of))
                of, choice = of[order], choice[order]
                new = np.flatnonzero(np.concatenate([[True], (choice[1:] != choice[:-1]) | (of[1:] != of[:-1])])) if len(of) else of
                again = np.diff(np.concatenate([new, [len(of)]])) > 1
                yield pa.RecordBatch.from_arrays([pa.array(choice[new].view(np.int64)), pa.array(key[a + of[new]]), pa.array(again)], ["choice", "key", "again"])

    return docs.select(F.xxhash64(text).alias("key"), F.col(text)).mapInArrow(run, "choice bigint, key bigint, again boolean")


def _segment_rows(candidates: DataFrame) -> DataFrame:
    """Segments of (sha, text, choices) rows whose choice is listed.

    ``starts`` has all places of equal segments in one text, ``place`` is that of the choice in
    the segment, ``segment`` a digest of the bytes.
    """

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            shas, wanted = batch.column(0).to_pylist(), batch.column(2)
            for a, b in slices(offsets, SCAN_BYTES):
                base = int(offsets[a])
                part = raw[base : offsets[b]]
                data = part.tobytes()
                of, begin, count, place, choice = choices(part, offsets[a : b + 1] - base)
                choice = choice.view(np.int64)
                cuts = np.searchsorted(of, np.arange(b - a + 1))
                keep = np.zeros(len(of), bool)
                for d, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
                    keep[i:j] = np.isin(choice[i:j], wanted[a + d].values.to_numpy())
                found: dict[tuple, list] = {}
                for d, at, n, p, c in zip(*(x[keep].tolist() for x in (of, begin, count, place, choice))):
                    own, start = data[at : at + n + WINDOW - 1], at + base - int(offsets[a + d])
                    key = d, c, hashlib.blake2b(own, digest_size=16).digest()
                    if key in found:
                        found[key][2].append(start)
                    else:
                        found[key] = [own, p - at, [start]]
                keys, rows = list(found), list(found.values())
                columns = [
                    pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.binary()), pa.array([r[0] for r in rows], pa.binary()),
                    pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([shas[a + k[0]] for k in keys], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["choice", "segment", "bytes", "size", "place", "sha", "starts"])

    return candidates.select("sha", "text", "choices").mapInArrow(run, "choice bigint, segment binary, bytes binary, size bigint, place bigint, sha string, starts array<bigint>")


@trimmed
def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole, at in ((b, at) for b in batches for at in range(0, len(b), 1024)):
        batch = whole.slice(at, 1024)
        out = []
        for row in batch.to_pylist():
            middle, count = (row["low"] + row["high"]) // 2, len(row["bytes"]) - WINDOW + 1
            for low, high in ((row["low"], middle), (middle, row["high"])):
                # Window i has the choice at place - i; those with low <= place - i < high stay.
                first, last = max(0, row["place"] - high + 1), min(count, row["place"] - low + 1)
                if first < last:
                    common = row["bytes"][row["place"] - low : row["place"] - high + 1 + WINDOW]
                    key = hashlib.blake2b(common + bytes([low, high]), digest_size=8, key=row["choice"].to_bytes(8, "little", signed=True)).digest()
                    out.append(row | {"deal": int.from_bytes(key, "little", signed=True), "skipped": row["skipped"] + first, "bytes": row["bytes"][first : last - 1 + WINDOW], "place": row["place"] - first, "low": low, "high": high})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)


def _dealt(segments: DataFrame, group_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Distinct segments with a dealing key ``deal`` and the windows ``skipped`` before the row's own bytes; and rows of single windows.

    Choices with more than ``group_bytes`` of segments are halved by the place range of the choice
    in the windows, and each half is dealt by the content that all its windows share, until all
    fit or the shared content is the whole window.  The rows of such a deal are one window.
    """
    own = segments.groupBy("choice", "segment").agg(F.first("bytes").alias("bytes"), F.first("place").alias("place"), F.sum(F.size("starts")).alias("n"))
    rows = own.select("choice", "segment", "bytes", "place", "n", F.col("choice").alias("deal"), *[F.lit(x).cast("bigint").alias(c) for c, x in (("skipped", 0), ("low", 0), ("high", WINDOW - KMER + 1))])
    sizes = segments.groupBy("choice", "segment").agg(F.first("size").alias("size")).groupBy(F.col("choice").alias("deal")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("members"))
    done = single = None
    while True:
        hot = pinned(sizes.filter((F.col("size") > group_bytes) & (F.col("members") > 1)).select("deal"))
        count = hot.count()
        cold = rows.join(hinted(hot, count, 16), "deal", "left_anti").select(*rows.columns) if count else rows
        done = cold if done is None else done.unionByName(cold)
        if not count:
            return done, single
        halves = pinned(rows.join(hinted(hot, count, 16), "deal", "left_semi").select(*rows.columns).mapInArrow(_halves, rows.schema))
        own, rows = halves.filter("high - low = 1"), halves.filter("high - low > 1")
        single = own if single is None else single.unionByName(own)
        sizes = rows.groupBy("deal").agg(F.sum(F.length("bytes")).alias("size"), F.count(F.lit(1)).alias("members"))


def _repeated_singles(single: DataFrame) -> DataFrame:
    """choice, segment, windows: the rows of single windows that stand in more places than one."""
    counts = pinned(single.groupBy("deal", "bytes").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("members")).filter("n > 1"))
    common, others = (counts.filter(c).select("deal", "bytes") for c in (F.col("members") > COMMON, F.col("members") <= COMMON))
    common, others = (hinted(x, x.count(), WINDOW + 64) for x in (common, others))
    on = ["deal", "bytes"]
    found = single.join(common, on, "left_semi").unionByName(single.join(common, on, "left_anti").join(others, on, "left_semi"))
    return found.select("choice", "segment", F.array(F.struct(F.col("skipped").alias("a"), (F.col("skipped") + 1).alias("b"))).alias("windows"))


# ---------------------------------------------------------------- merging transforms


def stable_order(key: np.ndarray) -> np.ndarray:
    """Stable argsort of non-negative integers under 2**32 by two counting passes."""
    low = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")
    high = (key >> 16).astype(np.uint16)
    return low[np.argsort(high[low], kind="stable")] if high.any() else low


class Shard:
    """A shard's suffix rows in order, their transform, and where each row's predecessor stands."""

    def __init__(self, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int):
        """``symbols``: for each position the rank of its SYMBOL bytes; begin/end: each position's segment."""
        n = len(symbols)
        at = np.arange(n)
        rank = np.where(at < end, symbols + 1, 0)  # positions at the end stand for the empty suffix
        step = SYMBOL
        while True:
            after = at + step
            key = rank * (n + int(rank.max()) + 2) + np.where(after < end, rank[np.minimum(after, n - 1)], 0)
            self.order = np.argsort(key)  # equal keys get one rank, in any order
            own = key[self.order]
            rank = np.empty(n, np.int64)
            rank[self.order] = np.cumsum(np.concatenate([[0], own[1:] != own[:-1]]))
            step *= 2
            if step >= window:
                break
        row = np.empty(n, np.int64)
        row[self.order] = at
        before = self.order - SYMBOL
        has = before >= begin[self.order]
        self.transform = np.where(has, symbols[np.maximum(before, 0)], -1)
        self.predecessor = np.where(has, row[np.maximum(before, 0)], -1)
        self.empty = int(np.count_nonzero(at >= end))


def repeated_windows(segments: list[bytes], window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each segment, whether each of its windows also stands elsewhere among the segments."""
    if window % SYMBOL:
        raise ValueError(f"the window must be a multiple of {SYMBOL}")
    sizes = np.array([len(s) + SYMBOL for s in segments], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    n = int(starts[-1])
    raw = np.frombuffer((b"\0" * SYMBOL).join([*segments, b"\0" * SYMBOL]), np.uint8)
    symbols = np.zeros(n, np.uint64)
    for k in range(SYMBOL):
        own = np.frombuffer(raw, ">u8", max(0, (len(raw) - k) // SYMBOL), k)
        room = len(range(k, n, SYMBOL))
        symbols[k::SYMBOL] = own[:room]
    symbols = np.unique(symbols, return_inverse=True)[1].astype(np.int64)

    shards, rows_of, base = [], [], 0
    cuts = np.searchsorted(starts, np.arange(0, n, shard_bytes))
    for a, b in zip(cuts, [*cuts[1:], len(segments)]):
        if a < b:
            low, high = int(starts[a]), int(starts[b])
            begin = np.repeat(starts[a:b] - low, sizes[a:b])
            end = np.repeat(starts[a + 1 : b + 1] - SYMBOL - low, sizes[a:b])
            one = Shard(symbols[low:high], begin, end, window)
            shards.append((one, base))
            rows_of.append(one.order + low)
            base += high - low
    transform = np.concatenate([s.transform for s, _ in shards]).astype(np.int32)
    predecessor = np.concatenate([np.where(s.predecessor >= 0, s.predecessor + at, -1) for s, at in shards]).astype(np.int32)
    empty = np.concatenate([np.arange(s.empty) + at for s, at in shards]).astype(np.int32)  # first rows of each shard

    merged, block = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
    for _ in range(window // SYMBOL):
        symbol = transform[merged]
        has = symbol >= 0
        merged, block, symbol = merged[has], block[has], symbol[has]
        order = stable_order(symbol)
        merged, block, symbol = predecessor[merged[order]], block[order], symbol[order]
        border = np.ones(len(merged) + 1, bool)
        border[1:-1] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        shared = ~(border[1:] & border[:-1])  # the others are alone in their block, for good
        block = np.cumsum(border[:-1], dtype=np.int32)[shared]
        merged = np.concatenate([empty, merged[shared]])
        block = np.concatenate([np.zeros(len(empty), np.int32), block])
    merged, block = merged[len(empty) :], block[len(empty) :]

    position = np.concatenate(rows_of)[merged]
    of = np.searchsorted(starts, position, side="right") - 1
    whole = position + window <= starts[of + 1] - SYMBOL
    position, block = position[whole], block[whole]
    flags = np.zeros(n, bool)
    if len(block):
        flags[position[np.bincount(block)[block] > 1]] = True
    return [flags[a : a + max(0, len(s) - window + 1)] for a, s in zip(starts[:-1].tolist(), segments)]


def runs(flags: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [{"a": a, "b": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def _repeated_runs(dealt: DataFrame) -> DataFrame:
    """choice, segment, windows: runs [a, b) of repeated windows of each distinct segment."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pending, size, deal = [], [], 0, None

        def flush():
            nonlocal pending, size
            flags = repeated_windows([r[2] for r in pending]) if pending else []
            out = [(r[0], r[1], [{"a": x["a"] + r[3], "b": x["b"] + r[3]} for x in runs(f)]) for r, f in zip(pending, flags)]
            pending, size = [], 0
            return [r for r in out if r[2]]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], ["choice", "segment", "windows"])

        def close_group():
            nonlocal group, size
            out = [(r[0], r[1], [{"a": r[3], "b": r[3] + len(r[2]) - WINDOW + 1}]) for r in group if r[4] > 1]
            if len(group) > 1:
                own = sum(len(r[2]) for r in group)
                if size + own > MERGE_BYTES:
                    out += flush()
                pending.extend(group)
                size += own
            group = []
            return out

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != deal:
                    out += close_group()
                    deal = row[0]
                group.append(row[1:])
            yield batch_of(out)
        out = close_group()
        yield batch_of(out + flush())

    own = dealt.select("deal", "choice", "segment", "bytes", "skipped", "n").repartition("deal").sortWithinPartitions("deal")
    return own.mapInArrow(run, "choice bigint, segment binary, windows array<struct<a: bigint, b: bigint>>")


# ---------------------------------------------------------------- operator


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """sha (SHA-256 of the text) and spans: the byte ranges [a, b) of it that are repeated, for texts that have any."""
    small_batches(docs.sparkSession)
    own = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(doc_id).cast("bigint").alias("id"))
    own = own.select("text", F.coalesce("id", F.xxhash64("text")).alias("row"))
    keyed = pinned(own.select("row", F.sha2("text", 256).alias("sha"), F.xxhash64("text").alias("key"), F.octet_length("text").cast("bigint").alias("n_bytes")))
    classes = keyed.filter(F.col("n_bytes") >= WINDOW).groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("row"), F.first("key").alias("key"), F.first("n_bytes").alias("n_bytes"))
    copied = classes.filter("copies > 1").select("sha", F.array(F.struct(F.lit(0).cast("bigint").alias("a"), F.col("n_bytes").alias("b"))).alias("spans"))

    rows, same = _choice_rows(own, "text"), W.partitionBy("choice")
    shared = rows.withColumns({"low": F.min("key").over(same), "high": F.max("key").over(same), "any": F.max("again").over(same)}).filter("low < high or any").groupBy("key").agg(F.collect_set("choice").alias("choices"))
    shared = pinned(classes.join(shared, "key").select("row", "sha", "choices"))
    total = shared.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("choices")).alias("c")).first()
    width = 128 + 8 * ((total["c"] or 0) // max(1, total["n"]))
    candidates = own.join(hinted(shared, total["n"], width), "row").filter(F.sha2("text", 256) == F.col("sha"))

    segments = written(_segment_rows(candidates), "segments")
    dealt, single = _dealt(segments, group_bytes)
    found = _repeated_runs(dealt)
    if single is not None:
        found = found.unionByName(_repeated_singles(single))
    found = pinned(found.groupBy("choice", "segment").agg(F.flatten(F.collect_list("windows")).alias("windows")))
    places = segments.select("choice", "segment", "sha", "starts").join(found, ["choice", "segment"])
    spans = F.flatten(F.transform("starts", lambda s: F.transform("windows", lambda w: F.struct((s + w["a"]).alias("a"), (s + w["b"] + (WINDOW - 1)).alias("b")))))
    inner = places.select("sha", spans.alias("spans")).groupBy("sha").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return inner.join(copied.select("sha"), "sha", "left_anti").unionByName(copied)


def _mask(n: int, spans: list[dict]) -> np.ndarray:
    """The bytes that stay."""
    change = np.zeros(n + 1, np.int64)
    for s in spans or ():
        change[s["a"]] += 1
        change[s["b"]] -= 1
    return np.cumsum(change)[:n] == 0


def _short(sha: str) -> Column:
    return F.conv(F.substring(sha, 1, 15), 16, 10).cast("bigint")


def _parted(docs: DataFrame, text: str, spans: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """The rows of ``docs`` that may have spans, with these last, and the others; and the name of the spans' column.

    Only the former's texts are shuffled to their spans: rows are told apart by a short key, which
    is broadcast while all keys are under the bound.
    """
    count = spans.count()
    sha, key, held = (unused(docs, x) for x in ("sha", "key", "spans"))
    keys = hinted(spans.select(_short("sha").alias(key)).distinct(), count, 16)
    keyed = docs.withColumn(sha, F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)).withColumn(key, _short(sha))
    own = spans.select(F.col("sha").alias(sha), F.col("spans").alias(held))
    return keyed.join(keys, key, "left_semi").drop(key).join(own, sha, "left").drop(sha), keyed.join(keys, key, "left_anti").drop(key, sha), held


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            spans, removed, count, kept = batch.column(2), [], [], []
            for k in range(len(batch)):
                own = raw[offsets[k] : offsets[k + 1]]
                stays = _mask(len(own), spans[k].as_py())
                removed.append(int(len(own) - np.count_nonzero(stays)))
                count.append(len(runs(~stays)))
                kept.append(hashlib.sha256(own[stays].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    touched, rest, held = _parted(own, "text", pinned(repeated_spans(docs, text, doc_id)))
    cut = touched.select("doc_id", "text", held).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    none = F.lit(0).cast("bigint")
    return cut.unionByName(rest.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256")))


def remove(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the repeated bytes removed; a character stays while one of its bytes does."""
    touched, rest, held = _parted(docs, text, pinned(repeated_spans(docs, text, doc_id)))
    at = docs.columns.index(text)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, s in zip(batch.column(at), batch.column(len(batch.columns) - 1)):
                if not s.is_valid:
                    out.append(t.as_py())
                    continue
                raw = np.frombuffer(t.as_py().encode("utf-8"), np.uint8)
                stays = _mask(len(raw), s.as_py())
                lead = np.flatnonzero((raw & 0xC0) != 0x80)  # first bytes of characters
                whole = np.maximum.reduceat(stays, lead) if len(lead) else stays
                out.append(raw[np.repeat(whole, np.diff(np.concatenate([lead, [len(raw)]])))].tobytes().decode("utf-8"))
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return touched.mapInArrow(run, docs.schema).unionByName(rest)
