"""The trie against one built by hand, turn by turn."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidewheel.llm import prefix_trie

SHAPE = "conv_id long, turn long, role string, text string, depth string, part string, hi string"


def ordered(rows):
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest())
    for row in sorted((r for r in rows if r[0] is not None), key=key):
        out.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    return out


def brute(convs):
    """Nodes of {conv_id: turns}."""
    members = {}
    for conv, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    out = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[:-1] == p for q in members)]
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(own), len(path), parent, len(own), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def case():
    rng = random.Random(4)
    texts = ["hi", "what is  it", "", None, "x\ty\nz", "ünder the sea"]
    rows = []
    for c in [*range(0, 70), 83, 84, 1001]:
        for t in range(rng.choice([1, 1, 2, 3, 4, 9])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(texts)))
    rows += [(5, 1, "user", "hi")] * 3 + [(None, 0, "user", "lost")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SHAPE)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("partitions", [1, 5])
def test_against_brute_force(spark, partitions):
    rows = case()
    own = prefix_trie.placed(prefix_trie.turns(frame(spark, rows).repartition(partitions)))
    conv = F.col("conv_id")
    got = rows_of(prefix_trie.trie(*prefix_trie.borrowed(own, conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4, most=3)))
    assert got == brute(rebuilt(ordered(rows)))


def test_conversations_as_they_are(spark):
    rows = case()
    assert rows_of(prefix_trie.conversation_trie(frame(spark, rows))) == brute(ordered(rows))


def test_one_long_conversation_and_one_common_start(spark):
    """A conversation with most rows lies in several parts, and half of the others are copies that end in one node."""
    rows = [(7, t, "user", f"w{t % 5} " * (t % 7)) for t in range(600)] + [(8, t, "user", f"w{t % 5} " * (t % 7)) for t in range(0, 300)]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 180) for t in range(2)]
    convs = ordered(rows)
    got = rows_of(prefix_trie.conversation_trie(frame(spark, rows)))
    want = {}
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault((d, hash(tuple(turns[:d]))), []).append(c)
    assert len(got) == len(members)
    by = {(r[0], r[1]): r for r in got}
    assert by[7, 0][3:6] == (82, 2, 2) and by[100, 2][3] == 80 and by[7, 600][4:7] == (0, 1, 0) and by[7, 300][3] == 2
    assert by[100, 2][7] == hashlib.sha256(",".join(map(str, range(100, 180))).encode()).hexdigest()
    saved = sum(len(f"w{t % 5} " * (t % 7)) // 3 for t in range(300))
    want = saved + 79 * 4
    assert by[7, 0][6] == want and by[7, 1][6] == saved
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = prefix_trie.placed(prefix_trie.turns(frame(spark, rows))).filter("conv_id = 7").agg(F.count_distinct("part"), F.count_distinct("at"), F.max("at")).first()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts[0] > 1 and parts[1] == parts[2] == 600


def test_blocks_of_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    rows = [(c, 0, "user", "a") for c in range(20)] + [(c, 0, "user", "b") for c in range(20, 25)]
    assert rows_of(prefix_trie.conversation_trie(frame(spark, rows))) == brute(ordered(rows))


def test_edges(spark):
    assert prefix_trie.conversation_trie(frame(spark, []).limit(0)).count() == 0
    assert prefix_trie.conversation_trie(frame(spark, [(None, 0, "user", "a")])).count() == 0
    long = "word " * 200_000
    rows = [(1, None, None, None), (1, 0, "user", long), (2, 0, "user", long), (2, 0, "user", long)]
    assert rows_of(prefix_trie.conversation_trie(frame(spark, rows))) == brute(ordered(rows))
