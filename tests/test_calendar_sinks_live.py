"""Offsets in months, sinks that pass their rows on, and operators over streams against their batch forms."""

import datetime as dt
import random

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_engine import table, values

import tidewheel as tw
from tidewheel import acausal
from tidewheel.context import add
from tidewheel.sources.memory import runs
from tidewheel.streaming import live_asof, live_rolling

D = dt.date


def test_months():
    assert add(D(2024, 1, 31), tw.months(1)) == D(2024, 2, 29) and add(D(2023, 1, 31), tw.months(1)) == D(2023, 2, 28)
    assert add(D(2024, 3, 31), -tw.months(1)) == D(2024, 2, 29) and add(dt.datetime(2024, 2, 29, 5), tw.years(1)) == dt.datetime(2025, 2, 28, 5)
    with pytest.raises(TypeError):
        add(3, tw.months(1))
    with pytest.raises(ValueError):
        tw.clock(tw.months(0)).load(tw.Context(D(2024, 1, 1), D(2024, 2, 1)))
    with pytest.raises(ValueError):
        (tw.clock(1) | tw.lag(tw.months(-1))).load(tw.Context(D(2024, 1, 1), D(2024, 2, 1)))


def test_a_clock_of_months_steps_from_tick_to_tick(spark):
    assert values(tw.clock(tw.months(1)), D(2024, 1, 31), D(2024, 6, 1), "time") == [D(2024, 1, 31), D(2024, 2, 29), D(2024, 3, 29), D(2024, 4, 29), D(2024, 5, 29)]
    assert values(tw.clock(tw.years(1)), dt.datetime(2024, 2, 29), dt.datetime(2027, 3, 1), "time") == [dt.datetime(2024, 2, 29), dt.datetime(2025, 2, 28), dt.datetime(2026, 2, 28), dt.datetime(2027, 2, 28)]


def test_shifts_of_months_keep_the_order(spark):
    rows = [(D(2024, 1, 29), 9), (D(2024, 1, 30), 5), (D(2024, 1, 31), 1), (D(2024, 2, 1), 7)]
    p = table(spark, "time date, x long", rows)
    assert values(p | tw.lag(tw.months(1)), D(2024, 2, 29), D(2024, 3, 31), "time", "x") == [(D(2024, 2, 29), 9), (D(2024, 2, 29), 5), (D(2024, 2, 29), 1), (D(2024, 3, 1), 7)]
    assert values(p | acausal.lead(tw.months(1)), D(2023, 12, 1), D(2024, 1, 31), "time", "x")[0] == (D(2023, 12, 29), 9)


def test_look_backs_and_tolerances_of_months(spark):
    rng = random.Random(3)
    days = sorted(D(2024, 1, 1) + dt.timedelta(days=rng.randrange(200)) for _ in range(80))
    rows = [(t, rng.choice("ab"), n) for n, t in enumerate(days)]
    p = table(spark, "time date, k string, x long", rows)
    window = {"m": tw.months(1), "q": tw.months(3), "z": tw.months(0), "w": 7}
    got = values(p | tw.add_rolling_columns(window, [tw.Count(), tw.Sum("x"), tw.First("x")], key="k"), D(2024, 1, 1), D(2024, 12, 1), *[f"{w}_{n}" for w in window for n in ("count", "x_sum", "x_first")])
    want = []
    for t, k, _ in rows:
        row = []
        for back in window.values():
            low = add(t, -back) if isinstance(back, tw.Months) else t - dt.timedelta(days=back)
            own = [x for s, other, x in rows if other == k and low <= s <= t]
            row += [len(own), sum(own), own[0]]
        want.append(tuple(row))
    assert got == want
    right = table(spark, "time date, y long", [(D(2024, 1, 29), 1), (D(2024, 4, 30), 2)])
    left = table(spark, "time date, z long", [(D(2024, 2, 29), 0), (D(2024, 3, 1), 1), (D(2024, 3, 30), 2), (D(2024, 3, 31), 3)])
    assert values(left | tw.asof_join(right, tolerance=tw.months(1)), D(2024, 2, 1), D(2024, 12, 1), "y") == [1, None, None, None]
    assert values(left | acausal.future_join(right, tolerance=tw.months(1)), D(2024, 2, 1), D(2024, 4, 1), "y") == [None, None, 2, 2]


def test_rows_behind_a_sink_are_evaluated_once_and_not_cached(spark, tmp_path):
    counted = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            counted.add(batch.num_rows)
            yield batch

    source = spark.range(100).select(F.col("id").alias("time"), F.col("id").alias("x"), F.lit("").alias("blank"), F.lit(None).cast("string").alias("none"))
    rows = lambda context: source.mapInArrow(count, source.schema)
    p = tw.from_dataframe(rows, order="x") | tw.write_csv(str(tmp_path / "c")) | tw.add_columns(lambda r: {"y": r.x * 2}) | tw.write_parquet(str(tmp_path / "p")) | tw.filter_rows(lambda r: r.y > 10)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    out = p.load(tw.Context(0, 50)).to_df()
    assert out.count() == 44 and out.filter("blank = '' and none is null").count() == 44
    assert counted.value == 100 and spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert spark.read.parquet(str(tmp_path / "p")).count() == 50 == spark.read.option("header", True).csv(str(tmp_path / "c")).count()
    counted.value = 0
    (tw.from_dataframe(rows, order="x") | tw.write_parquet(str(tmp_path / "q"))).scan(tw.Context(0, 50))
    assert counted.value == 100 and spark.read.parquet(str(tmp_path / "q")).columns == ["time", "x", "blank", "none"]


SECOND = dt.timedelta(seconds=1)
START = dt.datetime(2024, 1, 1)


def streamed(spark, folder, schema, batches):
    """A stream whose micro-batches are ``batches``, one file each."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drained(spark, df, name, tmp_path):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


@pytest.mark.parametrize("strict", [False, True])
def test_live_asof_equals_the_batch_join(spark, tmp_path, strict):
    rng = random.Random(9)
    made = lambda n, key: [sorted((START + (10 * b + rng.randrange(10)) * SECOND, rng.choice("ab"), key * 1000 + 10 * b + k) for k in range(n)) for b in range(4)]
    left, right = made(6, 1), made(5, 2)
    ends = [[(START + 1000 * SECOND, k, 0) for k in "ab"]]  # moves the watermark past all others
    live = live_asof(streamed(spark, tmp_path / "l", "time timestamp, k string, x long", left + ends), streamed(spark, tmp_path / "r", "time timestamp, k string, y long", right + ends), "k", tolerance=8 * SECOND, strict=strict, righttime="seen")
    got = sorted((r.x, r.seen, r.y) for r in drained(spark, live, f"asof{strict}", tmp_path).filter("x > 0").collect())
    flat = lambda batches, kind: tw.from_dataframe(spark.createDataFrame([r for b in batches for r in b], f"time timestamp, k string, {kind} long"), order=kind)
    utc = dt.timezone.utc
    window = tw.Context(START.replace(tzinfo=utc), (START + 900 * SECOND).replace(tzinfo=utc))
    want = (flat(left, "x") | tw.asof_join(flat(right, "y"), key="k", tolerance=8 * SECOND, strict=strict, righttime="seen")).load(window).to_df()
    assert got == sorted((r.x, r.seen, r.y) for r in want.collect()) and len(got) == 24


class Seen(tw.FoldSummarizer):
    fields = {"seen": "string"}

    def zero(self):
        return ()

    def update(self, state, row):
        return (*state, row.x)

    def merge(self, a, b):
        return a + b

    def finish(self, state, values):
        return {"seen": ",".join(map(str, sorted(state)))}


def test_live_rolling_equals_the_batch_form(spark, tmp_path):
    rng = random.Random(10)
    batches = [sorted((START + (10 * b + rng.randrange(10)) * SECOND, rng.choice("ab"), 10 * b + k + 1) for k in range(9)) for b in range(4)]
    ends = [[(START + 1000 * SECOND, k, 0) for k in "ab"]]
    live = live_rolling(streamed(spark, tmp_path / "s", "time timestamp, k string, x long", batches + ends), "w", 7 * SECOND, [Seen()], "k")
    got = sorted((r.x, r.w_seen) for r in drained(spark, live, "rolling", tmp_path).filter("x > 0").collect())
    rows = [r for b in batches for r in b]
    assert got == sorted((x, ",".join(str(y) for y in sorted(y for s, o, y in rows if o == k and t - 7 * SECOND <= s <= t))) for t, k, x in rows)


@settings(max_examples=300, deadline=None)
@example(50.0, 999.1885603880116, 4)
@given(st.floats(-1e6, 1e6), st.floats(1e-3, 1e3), st.integers(1, 3000))
def test_ticks_of_floats_are_repeated_additions(start, step, n):
    want, at = [], start
    for _ in range(n):
        want.append(at)
        at += step
    got = [first + k * spacing for first, count, spacing in runs(start, at, step) for k in range(count)]
    assert got == want


def test_long_float_clocks_cost_the_driver_little():
    made = list(runs(0.0, 3e8, 0.1))
    assert len(made) < 200 and sum(count for _, count, _ in made) > 2.9e9
    with pytest.raises(ValueError):
        list(runs(1e17, 2e17, 1.0))
