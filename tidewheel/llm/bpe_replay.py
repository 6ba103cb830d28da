"""Byte-level BPE encoding and decoding by merge replay.

Every shard of the corpus (whole documents, about ``SHARD_BYTES`` of text) is cut into its *distinct*
pre-token words.  One inverted index maps each mergeable token pair to the word positions that hold it,
and the merges are replayed over the whole shard in rank order: a merge visits exactly the
positions listed for it and touches only the two neighbours of each.  Words are independent of
each other, so replaying a shard at a time gives the same ids as replaying the whole corpus at
once, needs no shuffle, and its memory is bounded by the shard.

Defined edge cases: null or empty text has no ids; texts of any length are encoded whole;
repeated rows are encoded each; an empty table gives no rows; extra columns are carried where the caller asks for them and
may have any name (the internal columns are positional).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.shared import slices, small_batches, trimmed, utf8

#: Text in one shard; a longer document makes a shard of its own.
SHARD_BYTES = 4 << 20
_SHIFT = 20
_LOADED: dict[tuple[str, str], "Vocabulary"] = {}


class Vocabulary:
    """Ranks of a tiktoken file, and for each pair of tokens the token that their merge makes."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.words = regex.compile(pattern).findall
        left, right, made = [], [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(rank)
        left, right, made = (np.array(x, np.int64) for x in (left, right, made))
        # An open hash table, so that a whole array of pairs is looked up at once.
        self.bits = max(8, int(len(made) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.made = np.full(1 << self.bits, -1, np.int64)
        keys = left << _SHIFT | right
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot] == keys
            self.made[slot[placed]] = made[placed]
            keys, made, slot = keys[~placed], made[~placed], (slot[~placed] + 1) & len(self.keys) - 1
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        used = self.keys >= 0
        lower = np.concatenate([self.keys[used] >> _SHIFT, self.keys[used] & (1 << _SHIFT) - 1])
        #: Tokens that, once made, can pair with a neighbour at a lower rank than their own.
        self.uncovering = set(lower[np.tile(self.made[used], 2) < lower].tolist())

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that each pair makes, -1 where it makes none."""
        keys = left << _SHIFT | right
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.made[slot], -1)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & len(self.keys) - 1
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.made[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out

    @classmethod
    def load(cls, path: str, pattern: str) -> "Vocabulary":
        """One vocabulary per worker process and file."""
        if (path, pattern) not in _LOADED:
            _LOADED[path, pattern] = cls(path, pattern)
        return _LOADED[path, pattern]


def replay(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after another, and the offsets of each word's ids.

    A word that is itself a token keeps that token, as the reference encoders do.  Within one
    rank the leftmost of overlapping pairs wins.  A merge can uncover a pair of *lower* rank only
    for the tokens in ``vocabulary.uncovering``; then each word takes one merge of this rank and
    the rest wait their turn behind the uncovered pair.
    """
    ranks = vocabulary.ranks
    whole = [ranks.get(word, -1) for word in words]
    sizes = np.array([1 if known >= 0 else len(word) for known, word in zip(whole, words)], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    total = int(starts[-1])
    if not total:
        return np.zeros(0, np.int64), starts
    raw = b"".join(b"\0" if known >= 0 else word for known, word in zip(whole, words))
    token = vocabulary.single[np.frombuffer(raw, np.uint8)]
    known = np.array(whole, np.int64)
    token[starts[:-1][known >= 0]] = known[known >= 0]
    word_of = np.repeat(np.arange(len(words)), sizes)
    after, before = np.arange(1, total + 1), np.arange(-1, total - 1)
    after[starts[1:] - 1] = -1
    before[starts[:-1]] = -1

    index: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def note(at: np.ndarray) -> None:
        """List the positions ``at`` under the ranks of the pairs that start there."""
        rank = vocabulary.merged(token[at], token[after[at]])
        found = rank >= 0
        rank, at = rank[found], at[found]
        order = np.argsort(rank, kind="stable")
        rank, at = rank[order], at[order]
        cuts = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]])) if len(rank) else order
        for own, part in zip(rank[cuts].tolist(), np.split(at, cuts[1:])):
            if own in index:
                index[own].append(part)
            else:
                index[own] = [part]
                heapq.heappush(waiting, own)

    note(np.flatnonzero(after >= 0))
    while waiting:
        rank = heapq.heappop(waiting)
        at = np.sort(np.concatenate(index.pop(rank)))
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        at = at[(token[at] >= 0) & (after[at] >= 0)]
        nxt = after[at]
        valid = vocabulary.merged(token[at], token[nxt]) == rank  # the others were merged away
        at, nxt = at[valid], nxt[valid]
        if len(at) > 1:
            joint = np.concatenate([[False], nxt[:-1] == at[1:]])
            if joint.any():  # in a run of overlapping pairs every second one goes
                step = np.arange(len(at))
                run = np.maximum.accumulate(np.where(joint, 0, step))
                own = (step - run) % 2 == 0
                at, nxt = at[own], nxt[own]
            if rank in vocabulary.uncovering:
                one = np.concatenate([[True], word_of[at[1:]] != word_of[at[:-1]]])
                if not one.all():
                    index[rank] = [at[~one]]
                    heapq.heappush(waiting, rank)
                    at, nxt = at[one], nxt[one]
        if not len(at):
            continue
        far = after[nxt]
        token[at], token[nxt] = rank, -1
        after[at] = far
        has = far >= 0
        before[far[has]] = at[has]
        near = before[at]
        note(np.concatenate([at[has], near[near >= 0]]))
    alive = token >= 0
    kept = np.concatenate([[0], np.cumsum(alive)])
    return token[alive], kept[starts]


def encode_shard(texts: list[str | None], vocabulary: Vocabulary) -> Iterator[np.ndarray]:
    """Ids of each text as unsigned 32-bit integers."""
    found = [vocabulary.words(t) if t else [] for t in texts]
    coded = pa.array(itertools.chain.from_iterable(found), pa.large_string()).dictionary_encode()
    codes, ends = coded.indices.to_numpy(), np.cumsum([len(x) for x in found])
    del found
    ids, at = replay([w.encode("utf-8") for w in coded.dictionary.to_pylist()], vocabulary)
    ids, size = ids.astype("<u4"), np.diff(at)
    for own in np.split(codes, ends[:-1]) if len(texts) else []:
        count = size[own]
        last = np.cumsum(count)
        place = np.repeat(at[own] - (last - count), count) + np.arange(last[-1] if len(own) else 0)
        yield ids[place]


def encode_column(texts: pa.Array, vocabulary: Vocabulary) -> Iterator[np.ndarray]:
    """Ids of each text of an Arrow column, shard by shard."""
    for a, b in slices(utf8(texts)[1], SHARD_BYTES):
        yield from encode_shard(texts[a:b].to_pylist(), vocabulary)


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> bytes:
    tokens = vocabulary.tokens
    return b"".join([tokens[i] for i in ids.tolist()])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, then ``token_ids array<long>`` of the whole text and ``decoded binary``, their round trip."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(path, pattern)
        for batch in batches:
            encoded = list(encode_column(batch.column(0), vocabulary))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in encoded])]).astype(np.int32)
            flat = np.concatenate(encoded).astype(np.int64) if encoded else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            decoded = pa.array([decode(x, vocabulary) for x in encoded], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists, decoded], names)

    return _mapped(docs, text, keep, run, names := [*keep, "token_ids", "decoded"], "token_ids array<bigint>, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, then n_tokens, ids_sha256 and decoded_sha256 of the whole text."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(path, pattern)
        for batch in batches:
            count, ids_sha, back_sha = [], [], []
            for ids in encode_column(batch.column(0), vocabulary):
                count.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                back_sha.append(hashlib.sha256(decode(ids, vocabulary)).hexdigest())
            out = [pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *out], names)

    return _mapped(docs, text, keep, run, names := [*keep, "n_tokens", "ids_sha256", "decoded_sha256"], "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _mapped(docs, text, keep, run, names, added):
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(text).alias("__text"), *[F.col(c) for c in keep])
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return chosen.mapInArrow(run, ", ".join(x for x in (kinds, added) if x))
