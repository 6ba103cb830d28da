"""N-gram Jaccard join of whole documents: a size-aware heavy-light set join.

A document is the set of its word shingles.  Two sets of Jaccard similarity t share at least
ceil(t * a) tokens, a being either size, so under one global token order their prefixes of length
a - ceil(t * a) + c share at least c tokens.  The order puts frequent tokens last.  Tokens that no
other prefix has, and sets with fewer than c tokens left, are dismissed at once.

* Copies: documents with equal sets are one class; one representative goes on.
* Light sets enumerate all ``SUBSET``-token subsets of their prefix and meet in equal subsets.
* Heavy sets scan the inverted lists of their prefix tokens, where they meet light and heavy sets.
* The boundary between the two is the set size that makes the sum of enumerated subsets and
  reads of list entries smallest, from exact counts by size class.

For components, a list is not expanded into pairs.  Its members are checked against one central
member, then against the next 7, the next 56 and so on, and members already in one component are never
checked against each other; what remains is exact, and near copies cost one check each.

Defined edge cases: null or wordless text has an empty set, links with nothing and is its own
component; rows without an id do not stand for a class: they take the component of a row with
the same set, or null; repeated rows are copies of each other; of several texts under one id, the one with the smallest digest stands for
it in near links; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.llm.components import components
from tidewheel.llm.shared import bucketed, hinted, pinned, released, settled, sieve, slices, small_batches, trimmed, utf8
from tidewheel.llm.textscan import BLANK, LOWER, mix, sequence_hashes, word_hashes, words

SCAN_BYTES = 1 << 20
WORDS = 5
PERCENT = 80
#: Tokens in an enumerated subset.
SUBSET = 2
#: A set's prefix is longer by a token for so many tokens of the set.
SPARE = 16
#: A token is noted as frequent where a task's documents hold it so often, and the most frequent of
#: these come last in the order.  A task counts tokens that a slice of ``SLICE_BYTES`` of text has
#: twice, and of these ``COUNTED`` at most.  Any order is exact; this one keeps lists short.
OFTEN = 2
FREQUENT = 1 << 17
COUNTED = 1 << 20
SLICE_BYTES = 4 << 20
#: Reads of an inverted list's entry, one for each round that it takes part in: the cost of scanning
#: it, against that of one enumerated subset.
SCANS = 3
#: Each round checks lists against so many times as many members.
GROWTH = 8
#: Lists with more members are long: two members of several long lists are paired in one of them.
LONG = 32
#: Tokens with so many sets never meet in one task: they are known to be shared, and the members of
#: their lists are ranked in ``SALTS`` parts, or in more, of ``HOT`` members each.
HOT = 10_000
SALTS = 64
#: Broadcasts of a join have so many bytes at most: the driver holds each collected, as a table and in blocks, and several at a time.
SENT_BYTES = 8 << 20
#: Token buckets for each shuffle partition at least, and tokens of a bucket at most, by count.
BUCKETS, BUCKET_TOKENS = 8, 4 << 20
#: So many of the sets that a task has met are known to it, so that copies do not repeat their tokens.
MET = 1 << 17


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, b in slices(offsets, SCAN_BYTES):
        part, at = LOWER[raw[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = words(part, at, BLANK)
        hashes = word_hashes(part, starts, ends)
        shingles = sequence_hashes(hashes, size)
        for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
            if j - i >= size:
                own = np.sort(shingles[i : j - size + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            else:
                yield mix(sequence_hashes(hashes[i:j], j - i) + np.uint64(j - i)) if j > i else hashes[:0]


def least_common(size: int, percent: int) -> int:
    return -(-percent * size // 100)


def prefix_common(size: int) -> int:
    """Tokens that the prefixes of two similar sets must share.  More of them lengthen the prefix a
    little, and dismiss the many sets that share a few tokens with others by chance."""
    return max(SUBSET, 1 + size // SPARE)


def linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _scanned(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """doc_id, n_shingles and digest of each row's set; and, with ``n`` instead, tokens that a task's rows hold OFTEN."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, total = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, SLICE_BYTES):
                sizes, digests, own, seen = [], [], [np.zeros(0, np.uint64)], set()
                for tokens in shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size):
                    sizes.append(len(tokens))
                    digests.append(_digest(tokens) if len(tokens) else None)
                    if len(tokens) > 1 and digests[-1] not in seen:
                        seen.add(digests[-1])
                        own.append(tokens)
                token = np.sort(np.concatenate(own))
                new = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
                n = np.diff(np.concatenate([new, [len(token)]]))
                token, n = np.concatenate([often, token[new][n > 1]]), np.concatenate([total, n[n > 1]])
                often, where = np.unique(token, return_inverse=True)
                total = np.bincount(where, n, len(often)).astype(np.int64)
                if len(often) > COUNTED:
                    keep = np.sort(np.argsort(-total, kind="stable")[: COUNTED // 2])
                    often, total = often[keep], total[keep]
                known = [batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(b - a, pa.int64()), pa.nulls(b - a, pa.int64())]
                yield pa.RecordBatch.from_arrays(known, ["doc_id", "n_shingles", "digest", "token", "n"])
        often, total = often[total >= OFTEN].view(np.int64), total[total >= OFTEN]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(total), pa.int64()), pa.nulls(len(total), pa.int64()), pa.nulls(len(total), pa.binary()), pa.array(often), pa.array(total)], ["doc_id", "n_shingles", "digest", "token", "n"])

    chosen = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, token bigint, n bigint")


def frequent_tokens(scanned: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent tokens, sorted, and how many sets have them, as far as counted.  Bounded by FREQUENT."""
    counted = scanned.filter("n is not null").groupBy("token").agg(F.sum("n").alias("n"))
    found = counted.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    token, n = found.column("token").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], n[order].astype(np.int64)


def _members(known: DataFrame) -> DataFrame:
    """The smallest doc_id of each distinct set, as ``node``, with digest and size of the set."""
    return known.filter("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").cast("int").alias("size"))


def prefix(own: np.ndarray, often: np.ndarray, count: np.ndarray, marks: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A sorted set's prefix in the global order, rare tokens first, and the counts of its frequent tokens (else 0)."""
    n = len(own)
    least = least_common(n, percent)
    length = n - least + prefix_common(n) if least >= SUBSET else 0  # else only equal sets link
    maybe = np.flatnonzero(marks[(own >> np.uint64(42)).astype(np.int64)]) if length else own[:0]
    if len(maybe):
        where = np.minimum(np.searchsorted(often, own[maybe]), len(often) - 1)
        hit = often[where] == own[maybe]
        maybe, where = maybe[hit], where[hit]
    if not len(maybe):
        return own[:length], np.zeros(min(length, n), np.int64)
    order = np.argsort(np.frexp(count[where].astype(np.float64))[1], kind="stable")
    first = np.delete(own, maybe)[:length]
    more = length - len(first)
    return np.concatenate([first, own[maybe][order][:more]]), np.concatenate([np.zeros(len(first), np.int64), count[where][order][:more]])


def _packed_tokens(docs: DataFrame, doc_id: str, text: str, members: DataFrame, count: int, frequent: tuple, size: int, percent: int, buckets: int) -> DataFrame:
    """Prefix tokens of all sets, packed by bucket: the sets' keys, the tokens' last 32 bits, and marks.

    No text is joined to its member: a set is known by a key from its digest, which the members meet where tokens are
    gathered by set (``_shared_tokens``).  So texts are neither shuffled nor is a table of ``members``, of any ``count``, sent out.
    A mark holds, from its lowest bits, how far beyond the shortest prefix the token stands (0, 1, 2;
    2 bits), the bit length of the size (5 bits) and the token's place in the set's order (25 bits).
    HOT tokens come with the count ``n`` of their sets instead, in any bucket.
    """
    given = docs.sparkSession.sparkContext.broadcast(frequent)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, number = given.value
        marked, met = np.zeros(1 << 22, bool), set()
        marked[(often >> np.uint64(42)).astype(np.int64)] = True
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            for a, b in slices(offsets, SLICE_BYTES):
                nodes, tokens, marks, counts = [], [], [], []
                for own in shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size):
                    digest = _digest(own)
                    if not len(own) or digest in met:
                        continue
                    if len(met) >= MET:
                        met.clear()
                    met.add(digest)
                    token, n = prefix(own, often, number, marked, percent)
                    beyond = np.arange(len(token)) - (len(own) - least_common(len(own), percent))
                    nodes.append(np.full(len(token), int.from_bytes(digest[:8], "big", signed=True), np.int64))
                    tokens.append(token)
                    counts.append(n)
                    place = np.minimum(np.arange(len(token)), (1 << 25) - 1)
                    marks.append((place << 7 | min(31, len(own).bit_length()) << 2 | np.clip(beyond, 0, 2)).astype(np.uint32))
                if not nodes:
                    continue
                node, token, n, mark = (np.concatenate(x) for x in (nodes, tokens, counts, marks))
                bucket = (token >> np.uint64(32)) % np.uint64(buckets)
                tail = (token & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                hot = np.flatnonzero(n >= HOT)
                cold = np.flatnonzero(n < HOT)
                cold = cold[np.argsort(bucket[cold].astype(np.uint32), kind="stable")]
                own = bucket[cold]
                cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else own[:0].astype(np.int64)
                parts = np.split(cold, cuts[1:]) if len(cold) else []
                packed = [pa.array(own[cuts].astype(np.int32))]
                for values in (node, tail, mark):
                    packed.append(pa.array([values[p].tobytes() for p in parts], pa.binary()))
                yield pa.RecordBatch.from_arrays([*packed, pa.nulls(len(parts), pa.binary())], ["bucket", "nodes", "tails", "marks", "n"])
                if len(hot):
                    ids = (bucket[hot] << np.uint64(32) | tail[hot]).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([int(node[hot[0]] % buckets)], pa.int32()), *[pa.array([x], pa.binary()) for x in (node[hot].tobytes(), ids, mark[hot].tobytes(), n[hot].tobytes())]], ["bucket", "nodes", "tails", "marks", "n"])

    texts = docs.filter(F.col(doc_id).isNotNull()).select(F.col(text).alias("text"))
    return texts.mapInArrow(run, "bucket int, nodes binary, tails binary, marks binary, n binary")


def _key(digest: Column) -> Column:
    """The key of a set, from its digest.  Sets that share one share their tokens as well, which costs checks and loses nothing."""
    return F.conv(F.hex(F.substring(digest, 1, 8)), 16, -10).cast("bigint")


def _shared_tokens(packed: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """node, size, own (token, n sets that have it in their prefix, beyond, place) of the tokens that two
    sets or more share, of the nodes with enough of such tokens to link with a set of the least size
    that may; ``weight``, the sum of the lists' lengths.  Rows with a ``class`` give the summed
    lengths of the lists whose largest set is of that size class.

    Tokens are told apart by bucket and last 32 bits: that rare tokens may share a list costs a check
    and loses nothing.
    """

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(node, token, n, mark):
            # The lists' cost: each length once, under the class of the largest set.
            cost = np.zeros(64, np.int64)
            if len(node):
                new = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
                np.add.at(cost, np.maximum.reduceat(mark >> 2 & 31, new), np.diff(np.concatenate([new, [len(token)]])))
            classes = np.flatnonzero(cost)
            columns = [
                pa.concat_arrays([pa.array(node, pa.int64()), pa.nulls(len(classes), pa.int64())]), pa.concat_arrays([pa.nulls(len(node), pa.int32()), pa.array(classes, pa.int32())]),
                pa.concat_arrays([pa.array(token.view(np.int64)), pa.nulls(len(classes), pa.int64())]), pa.array(np.concatenate([n, cost[classes]])), *[pa.concat_arrays([pa.array(x.astype(np.int32)), pa.nulls(len(classes), pa.int32())]) for x in (mark & 3, mark >> 7)],
            ]
            return pa.RecordBatch.from_arrays(columns, ["node", "class", "token", "n", "beyond", "place"])

        def shared(bucket, held):
            node, tail, mark = (np.concatenate([np.frombuffer(x[k], kind) for x in held]) for k, kind in enumerate((np.int64, np.uint32, np.uint32)))
            order = np.argsort(tail, kind="stable")
            same = tail[order][1:] == tail[order][:-1]
            twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            order = order[twice]
            order = order[np.lexsort((node[order], tail[order]))]
            node, tail, mark = node[order], tail[order], mark[order]
            first = np.ones(len(node), bool)  # copies count once
            first[1:] = (node[1:] != node[:-1]) | (tail[1:] != tail[:-1])
            node, tail, mark = node[first], tail[first], mark[first]
            _, where, n = np.unique(tail, return_inverse=True, return_counts=True)
            keep = n[where] > 1
            return rows(node[keep], np.uint64(bucket) << np.uint64(32) | tail[keep].astype(np.uint64), n[where][keep], mark[keep])

        current, held = None, []
        for batch in batches:
            for bucket, nodes, tails, marks, n in zip(*(c.to_pylist() for c in batch.columns)):
                if n is not None:
                    yield rows(np.frombuffer(nodes, np.int64), np.frombuffer(tails, np.uint64), np.frombuffer(n, np.int64), np.frombuffer(marks, np.uint32))
                    continue
                if bucket != current and held:
                    yield shared(current, held)
                    held = []
                current = bucket
                held.append((nodes, tails, marks))
        if held:
            yield shared(current, held)

    sorted_ = packed.repartition("bucket").sortWithinPartitions("bucket")
    found = sorted_.mapInArrow(run, "key bigint, class int, token bigint, n bigint, beyond int, place int")
    sizes = members.select(_key(F.col("digest")).alias("key"), *[F.lit(None).cast(k).alias(c) for c, k in (("class", "int"), ("token", "bigint"), ("n", "bigint"), ("beyond", "int"), ("place", "int"))], F.struct("node", F.col("size").cast("int").alias("size")).alias("member"))
    own = F.collect_set(F.when(F.col("token").isNotNull(), F.struct("token", "n", "beyond", "place")))
    keyed = found.withColumn("member", F.lit(None).cast("struct<node:bigint,size:int>")).unionByName(sizes).groupBy("class", "key").agg(own.alias("own"), F.sum("n").alias("cost"), F.collect_set("member").alias("of"))
    weight = F.when(F.col("class").isNull(), F.aggregate("own", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])).otherwise(F.col("cost"))
    sized = keyed.select("class", "own", weight.alias("weight"), F.explode_outer("of").alias("of")).select("of.node", "of.size", "class", "own", "weight")
    needed = _common(_least(F.col("size"), percent))
    return sized.filter(F.col("class").isNotNull() | F.col("node").isNotNull() & (F.size("own") >= needed))


def _least(size: Column, percent: int) -> Column:
    return F.floor((size * percent + 99) / 100)


def boundary(tokens: DataFrame) -> int:
    """The largest size class (bit length of the size) whose sets enumerate subsets, by cost: the
    subsets of the light sets, and SCANS reads of each entry of the lists that a heavy set scans."""
    nodes = tokens.filter("class is null").select(F.length(F.bin("size")).alias("class"), F.size("own").cast("double").alias("k"))
    subsets = {r["class"]: r["n"] for r in nodes.groupBy("class").agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("n")).collect()}
    lists = {r["class"]: r["n"] for r in tokens.filter("class is not null").groupBy("class").agg(F.sum("weight").alias("n")).collect()}
    total = lambda x: sum(n for c, n in subsets.items() if c <= x) + SCANS * sum(n for c, n in lists.items() if c > x)
    return min([0, *sorted(subsets)], key=total)


def _lists(tokens: DataFrame, percent: int, light_to: int) -> DataFrame:
    """Lists whose members are candidates of each other: key, other, node, size, ``first`` and ``last``
    (places of the list's tokens in the set's order) and rank in the list, and the central member, which
    shares most tokens with others and has rank 1.

    Light sets stand in the lists of their subsets; all sets stand in the token lists that some
    heavy set scans.  Lists of HOT tokens are ranked in parts and always scanned: each part has a
    central member, and these come first among the ranks from 2 on.
    """
    light = F.length(F.bin("size")) <= light_to
    nodes = tokens.filter("class is null")
    in_order = F.sort_array(F.transform(F.filter("own", lambda x: x["beyond"] < SUBSET), lambda x: F.struct(x["place"].alias("place"), x["token"].alias("token"), x["n"].alias("n"))))
    own = nodes.filter(light).select("node", "size", "weight", in_order.alias("own"))
    hot = lambda x: x["n"] >= HOT
    pairs = F.flatten(F.transform("own", lambda x, i: F.transform(F.slice("own", i + 2, F.size("own")), lambda y: F.struct(x["token"].alias("key"), y["token"].alias("other"), (hot(x) & hot(y)).alias("hot"), F.least(x["n"], y["n"]).alias("n"), x["place"].alias("first"), y["place"].alias("last")))))
    enumerated = own.select("node", "size", "weight", F.explode(pairs).alias("p")).select("p.*", "node", "size", "weight", F.lit(True).alias("used"))
    entries = nodes.select("node", "size", "weight", F.explode(F.filter("own", lambda x: x["beyond"] == 0)).alias("x"))
    scanned = entries.select(F.col("x.token").alias("key"), F.lit(None).cast("bigint").alias("other"), hot(F.col("x")).alias("hot"), F.col("x.n").alias("n"), F.col("x.place").alias("first"), F.col("x.place").alias("last"), "node", "size", "weight", (~light).alias("used"))
    both = enumerated.union(scanned).withColumn("salts", F.greatest(F.lit(SALTS), F.ceil(F.col("n") / HOT)).cast("bigint")).drop("n")
    both = both.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.col("salts")) + 1).otherwise(F.lit(0)))
    same = W.partitionBy("key", "other", "salt")
    ranked = same.orderBy(F.desc("weight"), "node")
    both = both.withColumns({"members": F.count(F.lit(1)).over(same), "any": F.max("used").over(same), "number": F.row_number().over(ranked), "center": F.first(F.struct("node", "size", "last")).over(ranked)})
    rank = F.when(F.col("hot"), (F.col("number") - 1) * F.col("salts") + F.col("salt") + 1).otherwise(F.col("number"))
    return both.filter("hot or members > 1 and any").select("key", "other", "node", "size", "first", "last", rank.alias("rank"), "center", F.col("node").alias("component"))


def _possible(x: str, y: str, percent: int) -> Column:
    """Whether two members of a list can link, if its tokens are the first that they share: no more is
    shared than these and what comes after the last of them.  A pair whose first tokens are others
    meets in the list of those as well."""
    a, b = F.col(f"{x}size"), F.col(f"{y}size")
    most = F.when(F.col(f"{x}other").isNull(), 0).otherwise(1) + F.least(a - F.col(f"{x}last"), b - F.col(f"{y}last"))
    return 100 * most >= percent * (a + b - most)


def _sets(docs: DataFrame, doc_id: str, text: str, size: int, wanted: DataFrame) -> tuple:
    """node and its whole token set as bytes, for the (node, digest) rows of ``wanted``, in a table bucketed by node.

    Sets are made of the texts whose ids pass a sieve of the wanted ones, and meet the wanted rows by node: no text is shuffled.
    """

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, digests, sets = [], [], []
            for node, own in zip(batch.column(0).to_pylist(), shingle_sets(*utf8(batch.column(1)), size)):
                if len(own):
                    nodes.append(node)
                    digests.append(_digest(own))
                    sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["node", "digest", "tokens"])

    own = docs.select(F.col(doc_id).cast("bigint").alias("node"), F.col(text).alias("text")).filter("node is not null")
    passes = sieve(wanted.select("node"), wanted.count())
    made = passes(own, "node").mapInArrow(run, "node bigint, digest binary, tokens binary").withColumn("wanted", F.lit(False))
    both = made.union(wanted.select("node", "digest", F.lit(None).cast("binary"), F.lit(True)))
    gather = lambda dealt: dealt.groupBy("node", "digest").agg(F.first("tokens", True).alias("tokens"), F.max("wanted").alias("wanted")).filter("wanted and tokens is not null").select("node", "tokens")
    return bucketed(both, "token_sets", "node", gather)


def _common(size: Column) -> Column:
    """``prefix_common`` of a size."""
    return F.greatest(F.lit(SUBSET), 1 + F.floor(size / SPARE))


def _sharing(candidates: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The candidate pairs whose prefixes share as many tokens as those of two similar sets must."""
    x = prefixes.select(F.col("node").alias("a"), F.col("tokens").alias("x"), _common(F.col("size")).alias("m"))
    y = prefixes.select(F.col("node").alias("b"), F.col("tokens").alias("y"), _common(F.col("size")).alias("n"))
    both = candidates.join(y, "b").join(x, "a")
    return both.filter(F.size(F.array_intersect("x", "y")) >= F.least("m", "n")).select("a", "b")


def _near(candidates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs that link or may, by the last 32 bits of their tokens: half of the bytes to move.

    Equal tokens end in equal bits, so the count of common ends, each as often as both sets have it, is never too small.
    """

    @trimmed
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.frombuffer(x.as_buffer(), np.uint64).astype(np.uint32).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["a", "b", "x"])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.sort(np.frombuffer(x.as_buffer(), np.uint32)), np.sort(np.frombuffer(y.as_buffer(), np.uint64).astype(np.uint32))
                # The k-th equal end of one set meets the k-th of the other.
                x, y = (v.astype(np.uint64) << np.uint64(32) | (np.arange(len(v)) - np.searchsorted(v, v)).astype(np.uint64) for v in (x, y))
                keep.append(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
            own = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(own), batch.column(1).filter(own)], ["a", "b"])

    x = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    sent = candidates.join(x, "a").select("a", "b", "x").mapInArrow(ends, "a bigint, b bigint, x binary")
    return sent.join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _verified(candidates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs (a, b) that link."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                keep.append(linked(int(np.count_nonzero(both[1:] == both[:-1])), len(x), len(y), percent))
            own = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(own), batch.column(1).filter(own)], ["a", "b"])

    x = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    return candidates.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _central(lists: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of a list member with its central one, as far as they can link."""
    pairs = lists.select("node", "size", "last", "other", F.col("center.node").alias("c_node"), F.col("center.size").alias("c_size"), F.col("center.last").alias("c_last"))
    pairs = pairs.filter((F.col("node") != F.col("c_node")) & _possible("", "c_", percent))
    return pairs.select(F.least("node", "c_node").alias("a"), F.greatest("node", "c_node").alias("b")).distinct()


def _candidates(lists: DataFrame, first: int, last: int | None, percent: int) -> DataFrame:
    """Distinct pairs of a list member of rank first .. last with one of a later rank, as far as they can link."""
    ranked = lists.filter(F.col("rank") >= first)
    left = ranked.filter(F.col("rank") <= last) if last else ranked
    l, r = left.alias("l"), ranked.alias("r")
    on = (F.col("l.key") == F.col("r.key")) & F.col("l.other").eqNullSafe(F.col("r.other")) & (F.col("l.rank") < F.col("r.rank")) & (F.col("l.component") != F.col("r.component"))
    on = on & _possible("l.", "r.", percent)
    if "long" in lists.columns:
        # Two members of several long lists meet in the first of these only, in the order of tokens.
        once = F.get(F.array_intersect("l.long", "r.long"), F.lit(0)) == F.xxhash64("l.key", "l.other")
        on = on & F.coalesce(once, F.lit(True))
    return l.join(r, on).select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()


def _unresolved(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """``lists`` with the components found, where a list has more than one; ``members``, how many rows such a list has."""
    known = lists.drop("component", "center").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = known.groupBy("key", "other").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members")).filter("low < high")
    open_ = pinned(open_.select(F.col("key").alias("__key"), F.col("other").alias("__other"), "members"))
    on = (F.col("key") == F.col("__key")) & F.col("other").eqNullSafe(F.col("__other"))
    return known.drop("members").join(hinted(open_, open_.count(), 48, SENT_BYTES), on).drop("__key", "__other")


def _with_long(lists: DataFrame) -> DataFrame:
    """``lists`` with ``long``: of members of lists of over ``LONG`` members, all such lists that they stand in, in the order of tokens."""
    is_long = F.col("members") > LONG
    found = F.sort_array(F.collect_set(F.struct("first", "last", F.xxhash64("key", "other").alias("id"))))
    ids = pinned(lists.filter(is_long).groupBy("node").agg(F.transform(found, lambda x: x["id"]).alias("ids")))
    return lists.join(ids, "node", "left").withColumn("long", F.when(is_long, F.col("ids"))).drop("ids")


def _start(docs, doc_id, text, size, percent):
    small_batches(docs.sparkSession)
    scanned = pinned(_scanned(docs, doc_id, text, size))
    known = scanned.filter("n is null").select("doc_id", "n_shingles", "digest")
    members = pinned(_members(known))
    # Of several sets under one id, that with the smallest digest stands for the id in near links.
    wanted = members.groupBy("node").agg(F.min_by("size", "digest").alias("size"), F.min("digest").alias("digest"))
    wanted = pinned(wanted)
    total = known.filter("n_shingles > 0 and doc_id is not null").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles")).first()
    count, tokens = total["n"], (total["shingles"] or 0) * (100 - percent) // 100 + prefix_common(0) * total["n"]
    buckets = max(BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tokens // BUCKET_TOKENS))
    packed = _packed_tokens(docs, doc_id, text, wanted, count, frequent_tokens(scanned), size, percent, buckets)
    tokens = pinned(_shared_tokens(packed, wanted, percent))
    lists = pinned(_lists(tokens, percent, boundary(tokens)))
    released(docs.sparkSession)
    listed = lists.select("node").distinct()
    sets, drop = _sets(docs, doc_id, text, size, pinned(wanted.join(listed, "node", "left_semi")))
    prefixes, drop_prefixes = bucketed(tokens.filter("class is null").select("node", "size", F.col("own.token").alias("tokens")), "prefixes", "node")

    def check(candidates: DataFrame, mostly: bool = False) -> DataFrame:
        """The candidates that link; ``mostly``: most are expected to."""
        sharing = _sharing(candidates, prefixes)
        return _verified(sharing if mostly else _near(sharing, sets, percent), sets, percent)

    return known, members, lists, check, (drop, drop_prefixes)


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """All links (a, b), a < b, between the representatives of different sets; copies: ``join``."""
    _, _, lists, check, drops = _start(docs, doc_id, text, size, percent)
    out = pinned(check(_candidates(lists.drop("center"), 1, None, percent)).distinct())
    for drop in drops:
        drop()
    return out


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with the same set), component_id."""
    known, members, lists, check, drops = _start(docs, doc_id, text, size, percent)
    labels, first, last = None, 1, 1
    while lists.head(1):
        found = settled(check(_central(lists, percent), True) if last == 1 else check(_candidates(lists, first, last, percent)))
        if labels is not None:  # what was found before stands as its component
            x, y = labels.select(F.col("node").alias("a"), F.col("component").alias("p")), labels.select(F.col("node").alias("b"), F.col("component").alias("q"))
            found = found.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("p", "a").alias("a"), F.coalesce("q", "b").alias("b"))
            found = settled(found)
        new = settled(components(found))
        if labels is None:
            labels = new
        else:
            to = new.select(F.col("node").alias("component"), F.col("component").alias("to"))
            labels = settled(labels.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")).unionByName(new.join(labels.select("node"), "node", "left_anti")))
        rest = settled(_unresolved(lists.filter(F.col("rank") > last), labels))
        lists = rest if "long" in rest.columns else settled(_with_long(rest))
        first, last = last + 1, last * GROWTH
        released(docs.sparkSession)
    for drop in drops:
        drop()
    if labels is None:
        labels = members.select("node", F.col("node").alias("component")).limit(0)
    out = known.join(members.select("digest", "node"), "digest", "left").join(labels, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("node", "doc_id").alias("class_id"), F.coalesce("component", "node", "doc_id").alias("component_id"))
