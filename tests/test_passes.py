"""Ordered passes - joins, running and rolling summaries, custom folds - against brute force, whole and cut into ranges."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_engine import table, values

import tidewheel as tw
from tidewheel import acausal
from tidewheel.plans import ranges
from tidewheel.plans.folding import Queue

SUMMARIES = [tw.Count(), tw.Sum("q"), tw.Min("q"), tw.Max("q"), tw.First("q"), tw.Last("q"), tw.Mean("q"), tw.Product("q")]
NAMES = ["count", "q_sum", "q_min", "q_max", "q_first", "q_last", "q_mean", "q_product"]


class Words(tw.FoldSummarizer):
    """The symbols in order: a fold that does not commute.  Depends on the count."""

    fields = {"words": "string", "per": "double"}

    def dependencies(self):
        return [tw.Count()]

    def zero(self):
        return []

    def update(self, state, row):
        state.append(f"{row.sym}{row.q}")
        return state

    def merge(self, a, b):
        a.extend(b)  # a state may be changed: whoever merges it gives it away
        return a

    def finish(self, state, values):
        return {"words": "".join(state), "per": len(state) / values["count"] if values["count"] else None}


def rows_of(seed, n=60, span=40, hot=0.7):
    rng = random.Random(seed)
    return sorted(((rng.randrange(span), "a" if rng.random() < hot else rng.choice("bc"), rng.choice([None, 1, 2, 3, -1]) if seed % 2 else rng.choice([1, 2, 3, -2])) for _ in range(n)), key=lambda r: r[0])


def folded(own):
    """The results of SUMMARIES over values in order."""
    if not own:
        return (0, 0, None, None, None, None, None, 1)
    null = any(q is None for q in own)
    total = None if null else sum(own)
    return (len(own), total, None if null else min(own), None if null else max(own), own[0], own[-1], None if null else total / len(own), None if null else math.prod(own))


@pytest.mark.parametrize("seed, cut, key", [(1, None, "sym"), (2, 4, "sym"), (3, 5, None), (4, True, None), (6, None, None)])
def test_rolling_against_brute_force(spark, seed, cut, key):
    rows = rows_of(seed)
    p = table(spark, "time long, sym string, q long", rows)
    windows = {"s": 0, "m": 7, "l": 30}
    got = values(p | tw.add_rolling_columns(windows, SUMMARIES, key=key, by_buckets=cut), 10, 40, *[f"{w}_{n}" for w in windows for n in NAMES])
    seen = [[folded([q for s, k, q in rows if t - back <= s <= t and (key is None or k == own)]) for back in windows.values()] for t, own, _ in rows if t >= 10]
    want = [tuple(x for one in each for x in one) for each in seen]
    assert got == want


@pytest.mark.parametrize("cut", [None, 3])
def test_rolling_from_floats_and_look_backs_that_do_not_divide(spark, cut):
    rng = random.Random(5)
    left = sorted((rng.randrange(80) / 10, rng.choice("ab")) for _ in range(30))
    right = sorted(((rng.randrange(80) / 10, rng.choice("ab"), rng.choice([1.5, math.nan, math.inf, -math.inf, 2.5, 1e300])) for _ in range(40)), key=lambda r: r[0])
    l, r = table(spark, "time double, sym string", left), table(spark, "time double, sym string, q double", right)
    got = values(l | tw.add_rolling_columns(("w", 0.75), [tw.Count(), tw.Sum("q"), tw.Min("q")], key="sym", from_=r, by_buckets=cut), 0.0, 9.0, "w_count", "w_q_sum", "w_q_min")
    for (t, k), (n, total, least) in zip(left, got):
        own = [q for s, key, q in right if key == k and t - 0.75 <= s <= t]
        want = sum(own)
        assert n == len(own) and (math.isnan(total) if math.isnan(want) else total == want)
        assert least is None if not own else math.isnan(least) if any(map(math.isnan, own)) else least == min(own)


@pytest.mark.parametrize("key, other", [("sym", False), (None, False), ("sym", True)])
def test_custom_folds_roll(spark, key, other):
    rows, left = rows_of(8), rows_of(10, n=25)
    p, l = table(spark, "time long, sym string, q long", rows), table(spark, "time long, sym string, q long", left)
    rolled = (l if other else p) | tw.add_rolling_columns({"w": 6, "z": 0}, [Words(), tw.Sum("q")], key=key, from_=p if other else None)
    got = values(rolled, 5, 40, "w_words", "w_per", "w_q_sum", "z_words")
    want = []
    for t, own, _ in left if other else rows:
        if t >= 5:
            inside = [(k, q) for s, k, q in rows if t - 6 <= s <= t and (key is None or k == own)]
            tied = [(k, q) for s, k, q in rows if s == t and (key is None or k == own)]
            want.append(("".join(f"{k}{q}" for k, q in inside), 1.0 if inside else None, sum(q for _, q in inside), "".join(f"{k}{q}" for k, q in tied)))
    assert got == want


@pytest.mark.parametrize("key", ["sym", None])
def test_custom_folds_run_in_many_tasks(spark, key):
    rows = rows_of(12, n=200, hot=0.9)
    p = table(spark, "time long, sym string, q long", rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    running = p | tw.add_summary_columns([Words(), tw.Sum("q")], key=key)
    got = values(running, 0, 40, "words", "per", "q_sum")
    tasks = running.load(tw.Context(0, 40)).to_df().select(F.spark_partition_id().alias("p")).distinct().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 2
    want, so_far = [], {}
    for _, k, q in rows:
        own = so_far.setdefault(k if key else None, [])
        own.append((k, q))
        want.append(("".join(f"{a}{b}" for a, b in own), 1.0, sum(b for _, b in own)))
    assert got == want


def test_queue_of_states():
    rng = random.Random(1)
    for _ in range(50):
        queue, held, at = Queue(lambda: "", lambda a, b: a + b), [], 0
        for k in range(rng.randrange(40)):
            at += rng.randrange(3)
            queue.push(at, chr(97 + k % 26))
            held.append((at, chr(97 + k % 26)))
            least = at - rng.randrange(6)
            queue.evict(least)
            held = [h for h in held if h[0] >= least]
            assert queue.fold() == "".join(c for _, c in held)


@pytest.mark.parametrize("cut", [None, 3, True])
@pytest.mark.parametrize("key", ["sym", None])
def test_running_against_brute_force(spark, key, cut):
    rows = rows_of(13, n=50)
    got = values(table(spark, "time long, sym string, q long", rows) | tw.add_summary_columns(SUMMARIES, key=key, by_buckets=cut), 0, 40, *NAMES)
    so_far, want = {}, []
    for _, k, q in rows:
        own = so_far.setdefault(k if key else None, [])
        own.append(q)
        want.append(folded(own))
    assert got == want


@pytest.mark.parametrize("cut", [None, 4])
@pytest.mark.parametrize("key", ["sym", None])
@pytest.mark.parametrize("strict", [False, True])
def test_joins_in_ranges(spark, key, cut, strict):
    left, right = rows_of(20, n=50), rows_of(22, n=40)
    if key:  # null keys match
        left, right = ([(t, None if k == "c" else k, q) for t, k, q in side] for side in (left, right))
    l, r = table(spark, "time long, sym string, q long", left), table(spark, "time long, sym string, q long", right)
    r = r if key else r | tw.drop_columns("sym")
    for forward in (False, True):
        make = acausal.future_join if forward else tw.asof_join
        got = values(l | make(r, key=key, strict=strict, rightprefix="r", righttime="rt", by_buckets=cut), 0, 40, "rt", "r_q")
        want = []
        for t, k, _ in left:
            fits = (lambda s: s > t if strict else s >= t) if forward else (lambda s: s < t if strict else s <= t)  # noqa: B023
            own = [(s, q) for s, other, q in right if (key is None or other == k) and fits(s)]
            want.append((None, None) if not own else own[0] if forward else own[-1])
        assert got == want


def test_ranges_hold_equal_shares_of_a_burst_and_of_a_hot_key(spark):
    # 90 % of the rows of the hot key lie in 1 % of the time; other keys stay whole.
    rows = spark.range(40_000).select(F.when(F.col("id") % 10 == 0, F.col("id") * 1000).otherwise(20_000_000 + F.col("id")).alias("t"), F.when(F.col("id") % 4 == 3, F.concat(F.lit("k"), F.col("id") % 101)).otherwise("hot").alias("k"))
    for keys in (["k"], []):
        dealt = ranges.ranged(rows, keys, F.col("t"), 1000)
        sizes = [r["count"] for r in dealt.df.filter("__hot >= 0").groupBy(*dealt.by).count().collect()]
        assert len(sizes) >= 25 and max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2] and max(sizes) < 2000
        assert sum(sizes) == (30_000 if keys else 40_000) and dealt.df.count() == 40_000
        ordered = [r for r in dealt.df.filter("__hot >= 0").groupBy("__bucket").agg(F.min("t").alias("a"), F.max("t").alias("b")).orderBy("__bucket").collect()]
        assert all(x.b < y.a for x, y in zip(ordered, ordered[1:]))
    few = rows.limit(10)
    assert ranges.ranged(few, ["k"], F.col("t")).cut is None


def test_sources_of_a_join_are_scanned_once(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("time"), F.col("id").alias("x")).write.parquet(str(tmp_path / "l"))
    spark.range(1000).select(F.col("id").alias("time"), F.col("id").alias("y")).write.parquet(str(tmp_path / "r"))
    l, r = tw.read_parquet(str(tmp_path / "l")), tw.read_parquet(str(tmp_path / "r"))
    for p in (l | tw.asof_join(r), l | acausal.future_join(r)):
        plan = p.load(tw.Context(0, 1000)).to_df()._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 2
        cut = (l | tw.asof_join(r, by_buckets=100)).load(tw.Context(0, 1000)).to_df()
        assert "FileScan" not in cut._jdf.queryExecution().executedPlan().toString() and cut.filter("x = y").count() == 1000


def test_compensated_sums(spark):
    rows = [(k, "a", x) for k, x in enumerate([1.0, 1e100, 1.0, -1e100])] + [(5, "b", math.inf), (6, "b", 1.0), (7, "c", math.nan), (8, "d", None), (8, "d", 1.0), (9, "e", math.inf), (9, "e", -math.inf)]
    one = [tw.Sum("x", compensated=True)]
    for partitions in (1, 2, 3, 4, 9):
        frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "n long, time long, sym string, x double").repartition(partitions)
        p = tw.from_dataframe(frame, order="n") | tw.drop_columns("n")
        got = dict(values(p | tw.summarize(one, key="sym"), 0, 10, "sym", "x_sum"))
        assert got["a"] == 2.0 and got["b"] == math.inf and math.isnan(got["c"]) and got["d"] is None and math.isnan(got["e"])
    assert values(p | tw.add_summary_columns(one), 0, 4, "x_sum") == [1.0, 1e100, 1e100, 2.0]
    assert values(p | tw.add_rolling_columns(("w", 2), one), 0, 4, "w_x_sum") == [1.0, 1e100, 1e100, 1.0]
    assert values(p | tw.summarize(one), 4, 4, "x_sum") == [0.0]
    assert values(table(spark, "time long, x long", [(0, 2**60), (1, 3)]) | tw.summarize(one), 0, 4, "x_sum") == [2**60 + 3]
    plan = (p | tw.summarize(one, key="sym")).load(tw.Context(0, 4)).to_df()._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_products_of_large_groups(spark):
    rows = spark.range(100_000).select(F.col("id").alias("time"), F.when(F.col("id") % 20_000 == 1, 7).when(F.col("id") % 2 == 0, -1).otherwise(1).cast("bigint").alias("x"))
    product = tw.from_dataframe(rows, order="time") | tw.summarize(tw.Product("x"))
    assert values(product, 0, 100_000, "x_product") == [7**5]
    assert "collect_list" not in product.load(tw.Context(0, 9)).to_df()._jdf.queryExecution().toString()
    twos = lambda n, *more: table(spark, "time long, x long", [(k, 2) for k in range(n)] + [(n, x) for x in more]) | tw.summarize(tw.Product("x"))
    assert values(twos(62), 0, 99, "x_product") == [2**62] and values(twos(80, 0), 0, 99, "x_product") == [0]
    for wrong in (twos(63), twos(80)):
        with pytest.raises(Exception, match="overflow"):
            values(wrong, 0, 99, "x_product")


@pytest.mark.parametrize("key", ["k", None])
def test_tasks_of_a_pass_grow_in_number_with_the_rows(spark, monkeypatch, key):
    for name, value in (("SMALL_BYTES", 0), ("ROWS", 500), ("TASK_ROWS", 500)):
        monkeypatch.setattr(ranges, name, value, raising=False)
    rows = spark.range(40_000).select(F.col("id").alias("time"), (F.col("id") % 800).alias("k"), F.lit(1).alias("x"))
    source = tw.from_dataframe(rows, time="time", order="x")
    for p in (source | tw.add_summary_columns(tw.Count(), key=key), source | tw.add_rolling_columns(("w", 30_000), tw.Count(), key=key)):
        df = p.load(tw.Context(0, 40_000)).to_df()
        name = [c for c in df.columns if c.endswith("count")][0]
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 40_000 and max(sizes) < 6_000, sizes
        want = F.col("time") + 1 if key is None else F.floor(F.col("time") / 800) + 1
        frame = 30_001 if key is None else 38
        assert df.filter(F.col(name) != (F.least(want, F.lit(frame)) if name.startswith("w_") else want)).count() == 0
