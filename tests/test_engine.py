"""Literal cases of the engine: inputs and outputs side by side."""

import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import tidewheel as tw
from tidewheel import acausal


def table(spark, schema, rows):
    return tw.from_dataframe(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"n long, {schema}"), order="n") | tw.drop_columns("n")


def values(pipeline, start, stop, *names):
    df = pipeline.load(tw.Context(start, stop)).to_df(ordered=True)
    got = [tuple(r) for r in df.select(*names).collect()]
    return [g[0] for g in got] if len(names) == 1 else got


@pytest.fixture(scope="module")
def trades(spark):
    return table(spark, "time long, sym string, qty long", [(1, "a", 10), (2, "b", 20), (2, "a", 30), (4, "a", 40)])


def test_context():
    assert tw.Context(1, 2.5).start == 1.0
    assert tw.Context(dt.date(2024, 1, 1), dt.datetime(2024, 1, 2)).start == dt.datetime(2024, 1, 1)
    with pytest.raises(ValueError):
        tw.Context(2, 1)


def test_repr_and_validation(spark):
    df = spark.createDataFrame([(0, 1), (6, 2)], "time long, x long")
    frame = tw.LoadedFrame.from_df(tw.Context(0, 6), df)
    assert "over [0, 6]" in repr(frame) and len(frame) == 2
    with pytest.raises(ValueError):
        tw.LoadedFrame.from_df(tw.Context(0, 5), df)


def test_clock(spark):
    assert values(tw.clock(3), 0, 10, "time") == [0, 3, 6, 9]
    assert values(tw.clock(3), 0, 9, "time") == [0, 3, 6]
    assert values(tw.clock(0.1), 0.0, 0.35, "time") == [0.0, 0.1, 0.2, 0.30000000000000004]
    assert values(tw.clock(1), dt.date(2024, 2, 28), dt.date(2024, 3, 2), "time") == [dt.date(2024, 2, 28), dt.date(2024, 2, 29), dt.date(2024, 3, 1)]
    half = tw.clock(dt.timedelta(milliseconds=500))
    assert len(values(half, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 0, 2), "time")) == 4
    with pytest.raises(ValueError):
        tw.clock(0).load(tw.Context(0, 1))
    with pytest.raises(ValueError):
        tw.clock(1, batchsize=0)


def test_row_operators(spark, trades):
    assert values(trades | tw.filter_rows(lambda r: r.qty > 15), 0, 4, "qty") == [20, 30]
    assert values(trades | tw.filter_rows(lambda r: r.qty > 15, opaque=True), 0, 9, "qty") == [20, 30, 40]
    assert values(trades.add_columns(lambda r: {"twice": r.qty * 2}), 0, 3, "twice") == [20, 40, 60]
    assert values(trades.add_columns(lambda r: {"twice": r.qty * 2}, schema="twice long"), 0, 3, "twice") == [20, 40, 60]
    assert (trades | tw.select_columns("qty")).load(tw.Context(0, 9)).columns == ["time", "qty"]
    assert (trades | tw.drop_columns("qty")).load(tw.Context(0, 9)).columns == ["time", "sym"]
    for bad in (tw.add_columns(lambda r: {"qty": 1}), tw.add_columns(lambda r: {"time": 1}), tw.select_columns("none")):
        with pytest.raises(ValueError):
            (trades | bad).load(tw.Context(0, 9))
    with pytest.raises(TypeError):
        (trades | tw.filter_rows(lambda r: 3)).load(tw.Context(0, 9))
    for bad in (lambda: tw.select_columns(), lambda: tw.drop_columns("time")):
        with pytest.raises(ValueError):
            bad()


def test_shifts(spark, trades):
    assert values(trades | tw.lag(2), 3, 5, "time", "qty") == [(3, 10), (4, 20), (4, 30)]
    assert values(trades | acausal.lead(1), 1, 4, "time", "qty") == [(1, 20), (1, 30), (3, 40)]
    with pytest.raises(ValueError):
        (trades | tw.lag(-1)).load(tw.Context(0, 5))


def test_asof_and_future(spark):
    left = table(spark, "time long, px double", [(1, 1.0), (2, 2.0), (3, 3.0), (5, 5.0)])
    right = table(spark, "time long, qty long", [(0, 1), (2, 2), (4, 3)])
    assert values(left | tw.asof_join(right), 0, 6, "qty") == [1, 2, 2, 3]
    assert values(left | acausal.future_join(right), 0, 6, "qty") == [2, 2, 3, None]
    assert values(left | tw.asof_join(right, strict=True), 0, 6, "qty") == [1, 1, 2, 3]
    assert values(left | acausal.future_join(right, strict=True), 0, 6, "qty") == [2, 3, 3, None]
    assert values(left | tw.asof_join(right, tolerance=0), 0, 6, "qty") == [None, 2, None, None]
    assert values(left | tw.asof_join(right, tolerance=1, righttime="at"), 1, 6, "qty", "at") == [(1, 0), (2, 2), (2, 2), (3, 4)]
    ties = table(spark, "time long, qty long", [(2, 7), (2, 8)])
    assert values(left | tw.asof_join(ties), 0, 6, "qty") == [None, 8, 8, 8]
    assert values(left | acausal.future_join(ties), 0, 6, "qty") == [7, 7, None, None]
    with pytest.raises(ValueError):
        (left | tw.asof_join(left)).load(tw.Context(0, 6))
    assert (left | tw.asof_join(left, leftprefix="l", rightprefix="r")).load(tw.Context(0, 6)).columns == ["time", "l_px", "r_px"]
    with pytest.raises(ValueError):
        tw.asof_join(right, righttime="time")
    with pytest.raises(ValueError):
        (left | tw.asof_join(right, tolerance=-1)).load(tw.Context(0, 6))


def test_asof_null_keys(spark):
    left = table(spark, "time long, sym string", [(1, "a"), (2, None), (3, "a")])
    right = table(spark, "time long, sym string, qty long", [(0, None, 1), (1, "a", 2), (2, "b", 3)])
    for split in (False, True):
        assert values(left | tw.asof_join(right, key="sym", by_buckets=split), 0, 9, "qty") == [2, 1, 2]


def test_summaries(spark, trades):
    assert values(trades | tw.summarize([tw.Count(), tw.Sum("qty")]), 0, 5, "time", "count", "qty_sum") == [(5, 4, 100)]
    assert values(trades | tw.summarize([tw.Count(), tw.Sum("qty")], key="sym"), 0, 5, "sym", "count", "qty_sum") == [("a", 3, 80), ("b", 1, 20)]
    assert values(trades | tw.summarize([tw.Count(), tw.Sum("qty"), tw.Product("qty"), tw.Mean("qty"), tw.First("qty")]), 5, 9, "count", "qty_sum", "qty_product", "qty_mean", "qty_first") == [(0, 0, 1, None, None)]
    assert values(trades | tw.summarize_cycles(tw.Sum("qty")), 0, 5, "time", "qty_sum") == [(1, 10), (2, 50), (4, 40)]
    assert values(trades | tw.summarize_cycles(tw.Sum("qty"), key="sym"), 0, 5, "time", "sym", "qty_sum") == [(1, "a", 10), (2, "a", 30), (2, "b", 20), (4, "a", 40)]
    for split in (False, True):
        assert values(trades | tw.add_summary_columns([tw.Sum("qty"), tw.Last("sym")], key="sym", by_buckets=split), 0, 5, "qty_sum", "sym_last") == [(10, "a"), (20, "b"), (40, "a"), (80, "a")]
    assert values(trades | tw.add_summary_columns([tw.Sum("qty"), tw.First("qty"), tw.Min("qty"), tw.Product("qty")]), 0, 5, "qty_sum", "qty_first", "qty_min", "qty_product") == [(10, 10, 10, 10), (30, 10, 10, 200), (60, 10, 10, 6000), (100, 10, 10, 240000)]
    with pytest.raises(ValueError):
        (trades | tw.summarize([])).load(tw.Context(0, 5))
    with pytest.raises(ValueError):
        (trades | tw.add_columns(lambda r: {"count": 1}) | tw.summarize(tw.Count(), key="count")).load(tw.Context(0, 5))
    assert (trades | tw.summarize([tw.Variance("qty"), tw.Variance("qty", corrected=False)])).load(tw.Context(0, 5)).columns == ["time", "qty_variance"]


def test_statistics(spark):
    p = table(spark, "time long, x int, y int", [(1, 3, 2), (2, 1, 5), (3, 2, 4)])
    ss = [tw.Sum("x"), tw.Variance("x"), tw.Variance("y", corrected=False), tw.DotProduct("x", "y"), tw.Covariance("x", "y"), tw.SumPower("x", 2), tw.Moment("x", 2), tw.Std("x"), tw.Correlation("x", "y")]
    out = (p | tw.summarize(ss)).load(tw.Context(0, 5)).to_df().first().asDict()
    assert out["x_sum"] == 6 and out["x_variance"] == 1.0 and out["x_y_dotproduct"] == 19 and out["x_y_covariance"] == -1.5 and out["x_sumpower_2"] == 14
    assert math.isclose(out["x_moment_2"], 14 / 3) and math.isclose(out["y_variance"], 14 / 9) and math.isclose(out["x_y_correlation"], -0.9819805060619659)


def test_one_row_and_poison(spark):
    one = table(spark, "time long, x double, y double", [(1, 2.0, 3.0)])
    out = (one | tw.summarize([tw.Variance("x"), tw.Std("x"), tw.Correlation("x", "y"), tw.Covariance("x", "y", corrected=False)])).load(tw.Context(0, 5)).to_df().first()
    assert math.isnan(out["x_variance"]) and math.isnan(out["x_std"]) and math.isnan(out["x_y_correlation"]) and out["x_y_covariance"] == 0.0
    holes = table(spark, "time long, x double", [(1, 1.0), (2, None), (3, float("nan"))])
    out = (holes | tw.summarize([tw.Count(), tw.Sum("x"), tw.Min("x"), tw.Max("x"), tw.Mean("x"), tw.Product("x"), tw.Last("x")])).load(tw.Context(0, 5)).to_df().first()
    assert out["count"] == 3 and all(out[f"x_{k}"] is None for k in ("sum", "min", "max", "mean", "product")) and math.isnan(out["x_last"])
    nan = table(spark, "time long, x double", [(1, 1.0), (3, float("nan"))])
    assert math.isnan((nan | tw.summarize(tw.Min("x"))).load(tw.Context(0, 5)).to_df().first()["x_min"])


def test_result_types(spark):
    p = tw.from_dataframe(spark.sql("SELECT 1L AS time, CAST(1 AS TINYINT) AS a, CAST(1.5 AS FLOAT) AS f, true AS b"))
    kinds = dict((p | tw.summarize([tw.Sum("a"), tw.Sum("f"), tw.Sum("b"), tw.Min("a"), tw.Mean("f"), tw.Mean("a")])).load(tw.Context(0, 5)).to_df().dtypes)
    assert kinds == {"time": "bigint", "a_sum": "bigint", "f_sum": "float", "b_sum": "bigint", "a_min": "tinyint", "f_mean": "float", "a_mean": "double"}


def test_compensated(spark):
    p = table(spark, "time long, x double", [(1, 1.0), (2, 1e100), (3, 1.0), (4, -1e100)])
    assert values(p | tw.summarize(tw.Sum("x", compensated=True)), 0, 5, "x_sum") == [2.0]


def test_rolling(spark):
    p = table(spark, "time long, x long", [(1, 10), (2, 20), (3, 30), (5, 40), (8, 50)])
    assert values(p | tw.add_rolling_columns(("w", 2), tw.Sum("x")), 0, 9, "w_x_sum") == [10, 30, 60, 70, 50]
    ties = table(spark, "time long, x long", [(1, 1), (2, 2), (2, 3), (3, 4)])
    assert values(ties | tw.add_rolling_columns({"a": 0, "b": 1}, tw.Sum("x")), 0, 9, "a_x_sum", "b_x_sum") == [(1, 1), (5, 6), (5, 6), (4, 9)]
    assert values(ties | tw.add_rolling_columns(("w", 1), tw.Sum("x")), 2, 9, "w_x_sum") == [6, 6, 9]
    y = table(spark, "time long, y double", [(-2, 1.0), (0, 2.0), (1, 3.0), (4, 4.0)])
    assert values(p | tw.add_rolling_columns(("w", 3), [tw.Sum("y"), tw.Max("y")], from_=y), 1, 9, "w_y_sum", "w_y_max") == [(6.0, 3.0), (5.0, 3.0), (5.0, 3.0), (4.0, 4.0), (0.0, None)]
    floats = table(spark, "time double, x long", [(0.0, 1), (0.1, 2), (0.25, 4)])
    assert values(floats | tw.add_rolling_columns(("w", 0.1), tw.Sum("x")), 0.0, 1.0, "w_x_sum") == [1, 3, 4]
    with pytest.raises(ValueError):
        (p | tw.add_rolling_columns(("w", -1), tw.Sum("x"))).load(tw.Context(0, 5))
    with pytest.raises(ValueError):
        tw.add_rolling_columns({}, tw.Sum("x"))


def test_intervals(spark):
    p = table(spark, "time long, x long, k string", [(2, 10, "a"), (7, 20, "b"), (7, 30, "a"), (12, 40, "c")])
    c = tw.clock(5)
    assert values(p | tw.intervalize(c, [tw.Count(), tw.Sum("x")]), 0, 15, "time", "count", "x_sum") == [(5, 1, 10), (10, 2, 50)]
    assert values(p | tw.intervalize(c, [tw.Count(), tw.Sum("x")], closelast=True), 0, 15, "time", "x_sum") == [(5, 10), (10, 50), (15, 40)]
    assert values(p | tw.intervalize(c, tw.Sum("x"), key="k", closelast=True), 0, 15, "time", "k", "x_sum") == [(5, "a", 10), (10, "a", 30), (10, "b", 20), (15, "c", 40)]
    assert values(tw.empty_frame() | tw.add_columns(lambda r: {"x": F.lit(1)}) | tw.intervalize(c, [tw.Count(), tw.Sum("x")]), 0, 15, "time", "count", "x_sum") == [(5, 0, 0), (10, 0, 0)]
    assert values(p | tw.intervalize(tw.empty_frame(), tw.Count(), closelast=True), 0, 15, "count") == []
    odd = table(spark, "time long, label string", [(3, "x"), (9, "y")])
    assert values(p | tw.intervalize(odd, tw.Sum("x"), closelast=True), 0, 15, "time", "x_sum") == [(9, 50), (15, 40)]


class Longest(tw.FoldSummarizer):
    """The rows so far and the text of all rows in order: order matters."""

    fields = {"joined": "string", "share": "double"}

    def dependencies(self):
        return [tw.Count()]

    def zero(self):
        return ""

    def update(self, state, row):
        return state + row.sym

    def merge(self, a, b):
        return a + b

    def finish(self, state, values):
        return {"joined": state, "share": len(state) / max(1, values["count"])}


def test_custom_summarizer(spark, trades):
    assert values(trades | tw.summarize(Longest()), 0, 9, "joined", "share") == [("abaa", 1.0)]
    assert values(trades | tw.summarize([Longest(), tw.Sum("qty")], key="sym"), 0, 9, "sym", "joined", "qty_sum") == [("a", "aaa", 80), ("b", "b", 20)]


def test_sinks_and_files(spark, trades, tmp_path):
    csv, parquet = str(tmp_path / "c"), str(tmp_path / "p")
    trades.write_csv(csv).write_parquet(parquet).scan(tw.Context(0, 9))
    for single in (tw.read_csv(csv, types={"time": int, "qty": int}), tw.read_parquet(parquet)):
        assert sorted(values(single, 0, 4, "time", "sym", "qty")) == [(1, "a", 10), (2, "a", 30), (2, "b", 20)]
    renamed = tw.read_csv(csv, types={"time": int}, rename={"qty": "size"}, time=lambda r: r.time * 2)
    assert sorted(values(renamed, 0, 9, "time", "size")) == [(2, "10"), (4, "20"), (4, "30"), (8, "40")]
    with pytest.raises(TypeError):
        tw.read_csv(csv)
    with pytest.raises(TypeError):
        tw.read_csv(csv, types={"qty": int}).load(tw.Context(0, 9))
    with pytest.raises(ValueError):
        tw.read_parquet(parquet, time="none").load(tw.Context(0, 9))
    with pytest.raises(ValueError):
        tw.write_csv(csv, append=True)
    with pytest.raises(ValueError):
        tw.read_parquet(parquet, backend="other")
    spark.createDataFrame([(3,), (1,)], "time long").coalesce(1).write.parquet(str(tmp_path / "u"))
    with pytest.raises(Exception, match="not sorted"):
        tw.read_parquet(str(tmp_path / "u"), order="strict").load(tw.Context(0, 9)).count()


def test_pushdown(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("time"), F.col("id").alias("x"), F.col("id").alias("y")).write.parquet(str(tmp_path / "t"))
    plan = (tw.read_parquet(str(tmp_path / "t")) | tw.lag(5) | tw.select_columns("x")).load(tw.Context(15, 25)).to_df()._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(time,10)" in plan and "LessThan(time,20)" in plan and "y:" not in plan.split("ReadSchema")[-1]


def test_stream_tiles(spark, trades):
    frames = [(f.context.start, f.context.stop, f.to_df(ordered=True).toPandas().values.tolist()) for f in tw.stream(tw.Context(0, 5), trades, slices=3)]
    assert frames[0][0] == 0 and frames[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(frames, frames[1:]))
    assert [r for f in frames for r in f[2]] == [[1, "a", 10], [2, "b", 20], [2, "a", 30], [4, "a", 40]]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.sampled_from("ab")), min_size=1, max_size=12), st.lists(st.tuples(st.integers(0, 12), st.sampled_from("ab")), max_size=12), st.booleans())
def test_joins_against_brute_force(spark, left, right, strict):
    left, right = sorted(left, key=lambda r: r[0]), [(t, k, n) for n, (t, k) in enumerate(sorted(right, key=lambda r: r[0]))]
    l, r = table(spark, "time long, k string", left), table(spark, "time long, k string, v long", right)
    back = [max(([x[0], x[2]] for x in right if x[1] == k and (x[0] < t if strict else x[0] <= t)), default=[None, None])[1] for t, k in left]
    ahead = [min(([x[0], x[2]] for x in right if x[1] == k and (x[0] > t if strict else x[0] >= t)), default=[None, None])[1] for t, k in left]
    for split in (False, True):
        assert values(l | tw.asof_join(r, key="k", strict=strict, by_buckets=split), 0, 13, "v") == back
        assert values(l | acausal.future_join(r, key="k", strict=strict, by_buckets=split), 0, 13, "v") == ahead


def test_live(spark, tmp_path):
    from tidewheel.streaming import live, live_cycles, live_intervals, live_running

    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS time, id % 2 AS k, id AS x FROM range(10)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def drained(df, name):
        query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name)

    utc = dt.timezone.utc
    window = tw.Context(dt.datetime(2024, 1, 1, tzinfo=utc), dt.datetime(2024, 1, 1, 0, 0, 5, tzinfo=utc))
    assert drained(live(source(), lambda p: p | tw.filter_rows(lambda r: r.x > 1), window), "l").count() == 3
    assert drained(live_cycles(source(), [tw.Count(), tw.Sum("x")]), "c").agg(F.sum("x_sum")).first()[0] >= 36
    assert [r.x_sum for r in drained(live_intervals(source(), "4 seconds", tw.Sum("x")), "i").orderBy("time").collect()][:2] == [6, 22]

    class Total(tw.FoldSummarizer):
        fields = {"total": "long"}
        zero = lambda self: 0
        update = lambda self, s, row: s + row.x
        finish = lambda self, s, values: {"total": s}

    got = {r.x: r.total for r in drained(live_running(source(), [Total()], "k"), "r").collect()}
    assert got[8] == 20 if 8 in got else got
