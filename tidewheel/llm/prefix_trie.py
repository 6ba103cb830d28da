"""The trie of conversation prefixes, rolled up to every ancestor by pointer jumping.

* A turn becomes the SHA-256 of its role and text and a count of its words; texts travel no further.
* Turns are dealt by ranges of (conversation, order), so a conversation of any length lies in many
  *parts*.  Counts and digests of parts make their ordered exclusive prefix, a row for each part of
  each conversation, and every turn gets its position and the digest of the turns up to it.
* A prefix digest is the exclusive or of 128-bit hashes of (position, turn), so a node's parent is
  its digest without its last turn: each node is an edge keyed by digests.  Members of a node are
  counted by partial aggregates.
* Leaves and savings reach all ancestors by doubling: after k rounds a node holds the sums over the
  descendants less than 2**k below it and points to the ancestor 2**k above; a round adds what
  points to it and follows the pointer once.  Depth d takes log2(d) rounds.
* The ids that end in a node are joined in ordered blocks by many tasks; only the hash of a node's
  blocks, one after the other, runs in one task, over a stream of few rows.

Defined edge cases: rows without a conversation id are left out; null roles and texts are empty; null
turns come first, and rows of equal turn stand in the order of their digests, so repeated rows are turns of
their own; texts of any length are read whole; an empty table has no nodes; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.llm.shared import pinned, trimmed

WORD = r"[^\x20\x09-\x0D]+"
#: Ids joined into one block before the blocks of a node are hashed.
BLOCK = 4096
_NOTHING = hashlib.sha256(b"").hexdigest()
_ID = ("hi", "lo")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, key (the SHA-256 of role and text), words of every row of ``conversations``; checkpointed."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"),
        F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"), F.monotonically_increasing_id().alias("row"),
    )
    return pinned(rows)


def placed(rows: DataFrame) -> DataFrame:
    """conv_id, part, at (the turn's place from 1), key, words; the parts of a conversation follow each other in order."""
    dealt = rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "key", "row").withColumn("part", F.spark_partition_id())
    dealt = pinned(dealt)
    parts = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(_earlier()), F.lit(0)).alias("before")
    own = F.row_number().over(_within(F.col("turn").asc_nulls_first(), "key", "row"))
    numbered = dealt.select("conv_id", "part", "key", "words", own.alias("own"))
    joined = numbered.join(parts.select("conv_id", "part", before), ["conv_id", "part"])
    return pinned(joined.select("conv_id", "part", (F.col("before") + F.col("own")).alias("at"), "key", "words"))


def _earlier():
    """Over the parts of a conversation, at most one for each task: those before."""
    return W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)


def _within(*order: Column | str):
    return W.partitionBy("conv_id", "part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


def borrowed(own: DataFrame, lender: Column, share: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are another's, and their ids: ``conv_id`` takes the first ``share`` turns
    (``most`` at most) of the conversation ``lender``, as far as it has them, then its own after its first ``share``.

    ``own`` is a result of ``placed``; the turns taken are a part of their own before the others.
    """
    heads = own.filter(F.col("at") <= most).select("conv_id", F.struct("at", "key", "words").alias("turn"))
    heads = heads.groupBy(F.col("conv_id").alias("lender")).agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    parts = own.groupBy("conv_id", "part").agg(F.min("at").alias("first"))
    ids = parts.filter("first = 1").select("conv_id", lender.alias("lender"), share.alias("share"))
    taken = F.slice(F.coalesce("turns", F.array().cast("array<struct<at: bigint, key: binary, words: bigint>>")), 1, F.col("share").cast("int"))
    loans = pinned(ids.join(heads, "lender", "left").select("conv_id", "share", taken.alias("turns")))
    shifts = parts.join(loans.select("conv_id", "share", (F.size("turns") - F.col("share")).alias("shift")), "conv_id").select("conv_id", "part", "share", "shift")
    rest = own.join(shifts, ["conv_id", "part"]).filter("at > share")
    rest = rest.select("conv_id", (F.col("part") + 1).alias("part"), (F.col("at") + F.col("shift")).alias("at"), "key", "words")
    lent = loans.select("conv_id", F.lit(0).alias("part"), F.explode("turns").alias("t")).select("conv_id", "part", F.col("t.at").alias("at"), "t.key", "t.words")
    return pinned(rest.unionByName(lent)), loans.select("conv_id")


def prefixes(own: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, depth, hi, lo (the prefix), up_hi, up_lo (its parent), words (of its last turn) for every prefix of
    every conversation of ``ids``, the empty one included."""
    token = {"hi": F.xxhash64("at", "key"), "lo": F.xxhash64("key", F.lit("lo"), "at")}
    rows = own.select("conv_id", "part", "at", "words", *[token[c].alias(f"own_{c}") for c in _ID])
    inner = rows.select("*", *[F.bit_xor(f"own_{c}").over(_within("at")).alias(f"in_{c}") for c in _ID])
    parts = rows.groupBy("conv_id", "part").agg(*[F.bit_xor(f"own_{c}").alias(c) for c in _ID])
    carry = parts.select("conv_id", "part", *[F.coalesce(F.bit_xor(c).over(_earlier()), F.lit(0)).alias(f"carry_{c}") for c in _ID])
    whole = {c: F.col(f"in_{c}").bitwiseXOR(F.col(f"carry_{c}")) for c in _ID}
    full = inner.join(carry, ["conv_id", "part"]).select(
        "conv_id", F.col("at").cast("bigint").alias("depth"), *[whole[c].alias(c) for c in _ID], *[whole[c].bitwiseXOR(F.col(f"own_{c}")).alias(f"up_{c}") for c in _ID], "words"
    )
    zero = F.lit(0).cast("bigint")
    root = ids.select("conv_id", zero.alias("depth"), zero.alias("hi"), zero.alias("lo"), F.lit(None).cast("bigint").alias("up_hi"), F.lit(None).cast("bigint").alias("up_lo"), zero.alias("words"))
    return root.unionByName(full)


def ends(every: DataFrame) -> DataFrame:
    """hi, lo, ends_sha256: the digest of the ids, ascending and comma-joined, of the conversations that end in a node;
    ``every`` is a result of ``prefixes``."""
    last = every.groupBy("conv_id").agg(*[F.coalesce(F.bit_xor(F.col(c).bitwiseXOR(F.col(f"up_{c}"))), F.lit(0)).alias(c) for c in _ID])
    rows = last.select(*_ID, "conv_id").repartitionByRange(*_ID, "conv_id").sortWithinPartitions(*_ID, "conv_id")

    @trimmed
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []
        for batch in batches:
            out = []
            for hi, lo, conv in zip(*[c.to_pylist() for c in batch.columns]):
                if held and ((hi, lo) != node or len(held) >= BLOCK):
                    out.append((*node, held[0], ",".join(map(str, held))))
                    held = []
                node = (hi, lo)
                held.append(conv)
            yield _table(out)
        if held:
            yield _table([(*node, held[0], ",".join(map(str, held)))])

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["hi", "lo", "first", "ids"])

    @trimmed
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for hi, lo, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if (hi, lo) != node:
                    out += [(*node, state.hexdigest())] if node else []
                    node, state = (hi, lo), hashlib.sha256(ids.encode("ascii"))
                else:
                    state.update(b"," + ids.encode("ascii"))
            yield _digests(out)
        if node:
            yield _digests([(*node, state.hexdigest())])

    def _digests(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()))], ["hi", "lo", "ends_sha256"])

    joined = rows.mapInArrow(blocks, "hi bigint, lo bigint, first bigint, ids string")
    return joined.repartition(*_ID).sortWithinPartitions(*_ID, "first").mapInArrow(hashed, "hi bigint, lo bigint, ends_sha256 string")


def rolled_up(nodes: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """hi, lo and the sums of ``values`` over each node's subtree, by pointer jumping over the edges hi, lo -> up_hi, up_lo."""
    state = nodes.select(*_ID, "depth", "up_hi", "up_lo", *values)
    deepest, reach = nodes.agg(F.max("depth")).first()[0] or 0, 1
    while reach <= deepest:
        # Pointers span ``reach`` levels; nodes above that have none.
        below = state.filter(F.col("depth") >= reach).groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(*[F.sum(v).alias(f"add_{v}") for v in values])
        state = state.join(below, list(_ID), "left").select(*_ID, "depth", "up_hi", "up_lo", *[(F.col(v) + F.coalesce(f"add_{v}", F.lit(0))).alias(v) for v in values])
        reach *= 2
        if reach <= deepest:
            over = state.select(F.col("hi").alias("at_hi"), F.col("lo").alias("at_lo"), F.col("up_hi").alias("next_hi"), F.col("up_lo").alias("next_lo"))
            asked = _asking(state, F.col("depth") >= reach).join(over, ["at_hi", "at_lo"], "left")
            state = asked.select(*_ID, "depth", F.col("next_hi").alias("up_hi"), F.col("next_lo").alias("up_lo"), *values)
        state = pinned(state)
    return state.select(*_ID, *values)


def _asking(nodes: DataFrame, further: Column) -> DataFrame:
    """With at_hi, at_lo: the node pointed to, or the own one where nothing ``further`` is asked, so that no key gathers those."""
    return nodes.select("*", *[F.when(further, F.col(f"up_{c}")).otherwise(F.col(c)).alias(f"at_{c}") for c in _ID])


def trie(own: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the conversations ``ids``, whose turns ``own`` gives as ``placed`` does.

    conv_id (the smallest member), depth, parent_conv_id (the parent's conv_id; null for the root), n_convs, n_children,
    n_leaves (childless nodes in the subtree), saved_tokens (of the subtree: what n_convs - 1 members need not repeat
    of each node's last text), ends_sha256 (of the members that end here).
    """
    every = pinned(prefixes(own, ids))
    nodes = every.groupBy(*_ID).agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("up_hi").alias("up_hi"), F.min("up_lo").alias("up_lo"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words")
    )
    nodes = pinned(nodes)
    children = nodes.filter("depth > 0").groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(F.count(F.lit(1)).alias("n_children"))
    known = nodes.join(children, list(_ID), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint"))
    known = known.withColumns({"n_leaves": (F.col("n_children") == 0).cast("bigint"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")})
    parents = nodes.join(children, list(_ID)).select(F.col("hi").alias("at_hi"), F.col("lo").alias("at_lo"), F.col("conv_id").alias("other"))
    root = F.broadcast(nodes.filter("depth = 0").select(F.lit(1).cast("bigint").alias("depth"), F.col("conv_id").alias("first")))  # one row
    known = _asking(known, F.col("depth") > 1).join(parents, ["at_hi", "at_lo"], "left").join(root, "depth", "left")
    known = pinned(known.withColumn("parent_conv_id", F.when(F.col("depth") > 1, F.col("other")).otherwise(F.col("first"))))
    sums = rolled_up(known, ("n_leaves", "saved_tokens"))
    out = known.drop("n_leaves", "saved_tokens").join(sums, list(_ID)).join(ends(every), list(_ID), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text) as they are."""
    own = placed(turns(conversations))
    return trie(own, own.filter("at = 1").select("conv_id"))
