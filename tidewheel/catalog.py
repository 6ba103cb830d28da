"""The engine's queries over the test tables, and SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tidewheel as tw
from tidewheel import acausal
from tidewheel.plans.durable import shared_dir

DAY, HOUR = dt.timedelta(days=1), dt.timedelta(hours=1)
WEEK = tw.Context(dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 12))
MONTH = tw.Context(dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1))
SHIPPED = tw.Context(dt.datetime(1992, 1, 1), dt.datetime(1999, 1, 1))
#: Beyond the last row on either side, by a margin that shifts of an hour stay within.
EVENTS_WHOLE = tw.Context(dt.datetime(2023, 12, 31), dt.datetime(2024, 2, 2))
INTERVALS = tw.Context(dt.datetime(2024, 1, 5), dt.datetime(2024, 2, 3, 12))
INTERVALS_WHOLE = tw.Context(dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 3, 12))
SHIPPED_WHOLE = tw.Context(dt.datetime(1994, 12, 31), dt.datetime(2002, 1, 1))
YEAR_1900 = tw.Context(dt.datetime(1899, 1, 1), dt.datetime(1901, 1, 1))
YEAR_2040 = tw.Context(dt.datetime(2037, 1, 1), dt.datetime(2041, 1, 1))
_W = "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'"
_M = "ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'"
_S = "l_shipdate >= TIMESTAMP '1992-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'"


def events(sf_dir: str) -> tw.Pipeline:
    return tw.read_parquet(f"{sf_dir}/events.parquet", time="ts")


def lineitem(sf_dir: str) -> tw.Pipeline:
    return tw.read_parquet(f"{sf_dir}/lineitem.parquet", time="l_shipdate")


def of_type(sf_dir: str, kind: str) -> tw.Pipeline:
    return events(sf_dir) | tw.filter_rows(lambda r: r.event_type == kind) | tw.select_columns("event_id", "user_id", "value")


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    """Sums of floats depend on their order in the last places; both sides compare rounded ones."""
    return df.withColumns({n: F.round(n, digits) for n in names})


def _filter_rows(spark, d, context=WEEK):
    return (events(d) | tw.filter_rows(lambda r: (r.event_type == "purchase") & (r.value > 20))).load(context).to_df()


def _add_columns(spark, d, context=WEEK):
    p = events(d) | tw.add_columns(lambda r: {"double_value": r.value * 2, "is_click": r.event_type == "click"})
    return p.load(context).to_df().select("time", "event_id", "double_value", "is_click")


def _select_columns(spark, d, context=WEEK):
    import re

    return (events(d) | tw.select_columns("user_id", re.compile("^event_"))).load(context).to_df()


def _drop_columns(spark, d, context=WEEK):
    return (events(d) | tw.drop_columns("props", lambda n: n.startswith("event_t"))).load(context).to_df()


def ticks(spark, d, context=MONTH):
    """The ticks alone, for tests."""
    return tw.clock(DAY).load(context).to_df()


def float_ticks(spark, d, context=tw.Context(0.0, 100_000.0)):
    return tw.clock(0.25).load(context).to_df()


def nothing(spark, d, context=MONTH):
    return tw.empty_frame().load(context).to_df()


def _clock_day(spark, d, context=MONTH):
    return (tw.clock(DAY) | tw.asof_join(events(d) | tw.select_columns("event_id"), righttime="seen")).load(context).to_df()


def _clock_float(spark, d, context=tw.Context(0.0, 200_000.0)):
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_extendedprice", "l_quantity")
    return rounded((tw.from_dataframe(lines, time="l_extendedprice") | tw.intervalize(tw.clock(1000.0), [tw.Count(), tw.Sum("l_quantity")])).load(context).to_df(), "l_quantity_sum")


def _empty(spark, d, context=WEEK):
    p = events(d) | tw.select_columns("event_id") | tw.add_rolling_columns(("d", DAY), tw.Count(), from_=tw.empty_frame())
    return p.load(context).to_df()


def _from_dataframe(spark, d, context=tw.Context(dt.datetime(1995, 1, 1), dt.datetime(1996, 1, 1))):
    return tw.from_dataframe(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderdate"), time="o_orderdate", order="o_orderkey").load(context).to_df()


def _lag_1h(spark, d, context=WEEK):
    return (events(d) | tw.select_columns("event_id") | tw.lag(HOUR)).load(context).to_df()


def _lead_1h(spark, d, context=WEEK):
    return (events(d) | tw.select_columns("event_id") | acausal.lead(HOUR)).load(context).to_df()


def _summarize_all(spark, d, context=WEEK):
    return rounded((events(d) | tw.summarize([tw.Count(), tw.Sum("value"), tw.Mean("value"), tw.Min("value"), tw.Max("value")])).load(context).to_df(), "value_sum", "value_mean")


def _summarize_keyed(spark, d, context=WEEK):
    return rounded((events(d) | tw.summarize([tw.Count(), tw.Sum("value"), tw.Mean("value")], key="event_type")).load(context).to_df(), "value_sum", "value_mean")


def _pipeline_chain(spark, d, context=WEEK):
    p = events(d) | tw.filter_rows(lambda r: r.value > 10) | tw.add_columns(lambda r: {"fee": r.value * 0.5}) | tw.summarize([tw.Count(), tw.Sum("fee")], key=["event_type", "user_id"])
    return rounded(p.load(context).to_df(), "fee_sum")


def _cycles(spark, d, context=SHIPPED):
    return rounded((lineitem(d) | tw.summarize_cycles([tw.Count(), tw.Sum("l_quantity"), tw.Max("l_discount")])).load(context).to_df(), "l_quantity_sum")


def _cycles_keyed(spark, d, context=SHIPPED):
    return rounded((lineitem(d) | tw.summarize_cycles([tw.Count(), tw.Sum("l_extendedprice")], key="l_returnflag")).load(context).to_df(), "l_extendedprice_sum", digits=2)


def _running(key):
    def query(spark, d, context=WEEK):
        p = events(d) | tw.select_columns("event_id", "user_id", "value") | tw.add_summary_columns([tw.Count(), tw.Sum("value"), tw.Max("value"), tw.First("event_id"), tw.Last("event_id"), tw.Mean("value")], key=key)
        # Means of amounts often end in a 5 to be rounded; the shift keeps both sides off that edge.
        return rounded(p.load(context).to_df().drop("value").withColumn("value_mean", F.col("value_mean") + 1e-7), "value_sum", "value_mean")

    return query


def _running_sql(key: str, window: str = _W) -> str:
    over = f"({'PARTITION BY user_id ' if key else ''}ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
    return f"""SELECT ts AS time, event_id, user_id, count(*) OVER {over} AS count, round(sum(value) OVER {over}, 4) AS value_sum, max(value) OVER {over} AS value_max,
        first_value(event_id) OVER {over} AS event_id_first, event_id AS event_id_last, round(sum(value) OVER {over} / count(*) OVER {over} + 1e-7::DOUBLE, 4) AS value_mean FROM events WHERE {window}"""


def _rolling(spark, d, context=WEEK, by_buckets=None):
    p = events(d) | tw.select_columns("event_id", "user_id", "value") | tw.add_rolling_columns({"h": HOUR, "d": DAY}, [tw.Count(), tw.Sum("value"), tw.Max("value")], key="user_id", by_buckets=by_buckets)
    return rounded(p.load(context).to_df().drop("value"), "h_value_sum", "d_value_sum")


def _rolling_wide(spark, d, context=WEEK):
    p = events(d) | tw.select_columns("event_id", "value") | tw.add_rolling_columns(("w", 15 * DAY), [tw.Count(), tw.Sum("value"), tw.Max("value"), tw.First("event_id")])
    return rounded(p.load(context).to_df().drop("value"), "w_value_sum")


def _rolling_months(spark, d, context=SHIPPED):
    p = lineitem(d) | tw.select_columns("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity") | tw.add_rolling_columns(("m", tw.months(2)), [tw.Count(), tw.Max("l_quantity")], key="l_returnflag")
    return p.load(context).to_df().drop("l_quantity")


def _rolling_custom(spark, d, context=WEEK):
    p = events(d) | tw.select_columns("event_id", "user_id", "value") | tw.add_rolling_columns(("d", DAY), [tw.Count(), _Spread("value")], key="user_id")
    return p.load(context).to_df().drop("value")


def _running_custom(spark, d, context=WEEK):
    p = events(d) | tw.select_columns("event_id", "event_type", "value") | tw.add_summary_columns([tw.Count(), _Spread("value")], key="event_type")
    return p.load(context).to_df().drop("value")


def _interval_months(spark, d, context=SHIPPED):
    return rounded((lineitem(d) | tw.intervalize(tw.clock(tw.months(1)), [tw.Count(), tw.Sum("l_quantity")])).load(context).to_df(), "l_quantity_sum")


def _interval_custom(spark, d, context=INTERVALS):
    return (events(d) | tw.intervalize(tw.clock(DAY), [tw.Count(), _Spread("value")])).load(context).to_df()


def _lag_month(spark, d, context=WEEK):
    context = tw.Context(tw.context.add(context.start, tw.months(1)), tw.context.add(context.stop, tw.months(1)))
    return (events(d) | tw.select_columns("event_id") | tw.lag(tw.months(1))).load(context).to_df()


def _rolling_keyless(spark, d, context=WEEK):
    p = events(d) | tw.select_columns("event_id", "value") | tw.add_rolling_columns(("h", HOUR), [tw.Count(), tw.Sum("value"), tw.Min("value"), tw.Last("event_id")])
    return rounded(p.load(context).to_df().drop("value"), "h_value_sum")


def _rolling_from(spark, d, context=WEEK):
    p = of_type(d, "click") | tw.drop_columns("value") | tw.add_rolling_columns(("d", DAY), [tw.Count(), tw.Sum("value")], key="user_id", from_=of_type(d, "purchase"))
    return rounded(p.load(context).to_df(), "d_value_sum")


def _joined(forward=False, key="user_id", **options):
    def query(spark, d, context=WEEK):
        right = of_type(d, "purchase") | tw.select_columns(*([key] if key else []), "event_id", "value")
        make = acausal.future_join if forward else tw.asof_join
        p = of_type(d, "click") | tw.select_columns("event_id", "user_id") | make(right, key=key, rightprefix="p", righttime="ptime", **options)
        return p.load(context).to_df()

    return query


def _joined_sql(op: str, bound: str = "", key: bool = True, widen: str = _W, window: str = _W) -> str:
    on = f"l.ts {op} r.ts" + (" AND l.user_id = r.user_id" if key else "")
    take = lambda c, n: f"CASE WHEN {bound} THEN r.{c} END AS {n}" if bound else f"r.{c} AS {n}"
    return f"""SELECT l.ts AS time, l.event_id, l.user_id, {take('ts', 'ptime')}, {take('event_id', 'p_event_id')}, {take('value', 'p_value')}
        FROM (SELECT * FROM events WHERE event_type = 'click' AND {window}) l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase' AND {widen}) r ON {on}"""


def _asof_self_prev(spark, d, context=WEEK):
    own = events(d) | tw.select_columns("event_id", "user_id")
    return (own | tw.asof_join(own, key="user_id", strict=True, rightprefix="prev")).load(context).to_df()


def _interval(key=None, closelast=False):
    def query(spark, d, context=INTERVALS):
        p = events(d) | tw.intervalize(tw.clock(DAY), [tw.Count(), tw.Sum("value"), tw.Max("value")], key=key, closelast=closelast)
        return rounded(p.load(context).to_df(), "value_sum")

    return query


def _interval_sql(key: str = "", closelast: bool = False, start: str = "2024-01-05", first: str = "2024-01-06") -> str:
    ends = f"SELECT CAST(range AS TIMESTAMP) AS b FROM range(TIMESTAMP '{first}', TIMESTAMP '2024-02-03 00:00:01', INTERVAL 1 DAY)" + (" UNION ALL SELECT TIMESTAMP '2024-02-03 12:00:00'" if closelast else "")
    rows = f"SELECT *, least(date_trunc('day', ts) + INTERVAL 1 DAY, TIMESTAMP '2024-02-03 12:00:00') AS b FROM events WHERE ts >= TIMESTAMP '{start}' AND ts < TIMESTAMP '2024-02-03 12:00:00'"
    if not closelast:
        rows += " AND ts < TIMESTAMP '2024-02-03'"
    if key:
        return f"SELECT b AS time, {key}, count(*) AS count, round(sum(value), 4) AS value_sum, max(value) AS value_max FROM ({rows}) GROUP BY b, {key}"
    return f"SELECT e.b AS time, count(r.ts) AS count, round(coalesce(sum(value), 0.0), 4) AS value_sum, max(value) AS value_max FROM ({ends}) e LEFT JOIN ({rows}) r ON e.b = r.b GROUP BY e.b"


def _summary(make, *names, digits=4):
    def query(spark, d, context=SHIPPED):
        own = make()
        out = (lineitem(d) | tw.summarize(own, key="l_returnflag")).load(context).to_df()
        return rounded(out, *own.outputs, digits=digits) if digits is not None else out

    return query


_N = "count(*)"
_MOMENT = lambda x, y: f"(sum({x} * {y}) - sum({x}) * sum({y}) / {_N})"
_VAR = lambda x: f"{_MOMENT(x, x)} / ({_N} - 1)"
_SUMMARIES: dict[str, tuple[Callable[[], tw.Summarizer], str, int | None]] = {
    "count": (lambda: tw.Count(), f"{_N}", None),
    "sum": (lambda: tw.Sum("l_linenumber"), "CAST(sum(l_linenumber) AS BIGINT)", None),
    "sum_float": (lambda: tw.Sum("l_tax"), "sum(l_tax)", 4),
    "sumpower": (lambda: tw.SumPower("l_linenumber", 3), "CAST(sum(l_linenumber * l_linenumber * l_linenumber) AS BIGINT)", None),
    "dotproduct": (lambda: tw.DotProduct("l_quantity", "l_discount"), "sum(l_quantity * l_discount)", 2),
    "moment": (lambda: tw.Moment("l_discount", 2), f"sum(l_discount * l_discount) / {_N}", 6),
    "mean": (lambda: tw.Mean("l_quantity"), f"sum(l_quantity) / {_N}", 4),
    "variance": (lambda: tw.Variance("l_quantity"), _VAR("l_quantity"), 4),
    "std": (lambda: tw.Std("l_quantity"), f"sqrt(greatest({_VAR('l_quantity')}, 0))", 4),
    "covariance": (lambda: tw.Covariance("l_quantity", "l_extendedprice"), f"{_MOMENT('l_quantity', 'l_extendedprice')} / ({_N} - 1)", 1),
    "correlation": (lambda: tw.Correlation("l_quantity", "l_extendedprice"), f"{_MOMENT('l_quantity', 'l_extendedprice')} / ({_N} - 1) / (sqrt({_VAR('l_quantity')}) * sqrt({_VAR('l_extendedprice')}))", 6),
    "compensated": (lambda: tw.Sum("l_discount", compensated=True), "sum(l_discount)", 4),
    "min": (lambda: tw.Min("l_extendedprice"), "min(l_extendedprice)", None),
    "max": (lambda: tw.Max("l_extendedprice"), "max(l_extendedprice)", None),
}


def _product(spark, d):
    p = lineitem(d) | tw.filter_rows(lambda r: r.l_orderkey < 40) | tw.summarize(tw.Product("l_linenumber"), key="l_orderkey")
    return p.load(SHIPPED).to_df()


def _product_whole(spark, d):
    return (lineitem(d) | tw.summarize(tw.Product("l_linenumber"), key="l_orderkey")).load(SHIPPED_WHOLE).to_df()


def _first_last(spark, d, context=WEEK):
    p = events(d) | tw.summarize([tw.First("event_id"), tw.Last("event_id")], key="user_id")
    return p.load(context).to_df()


class _Spread(tw.FoldSummarizer):
    """The range of a column, as an example of a custom summarizer."""

    def __init__(self, x: str):
        self.x, self.fields = x, {f"{x}_low": "double", f"{x}_high": "double"}

    def zero(self):
        return None

    def update(self, state, row):
        v = getattr(row, self.x)
        return (v, v) if state is None else (min(state[0], v), max(state[1], v))

    def merge(self, a, b):
        return b if a is None else a if b is None else (min(a[0], b[0]), max(a[1], b[1]))

    def finish(self, state, values):
        low, high = state or (None, None)
        return {f"{self.x}_low": low, f"{self.x}_high": high}


def _custom(spark, d, context=WEEK):
    return (events(d) | tw.select_columns("event_type", "value") | tw.summarize([tw.Count(), _Spread("value")], key="event_type")).load(context).to_df()


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _parquet_roundtrip(spark, d, context=WEEK):
    folder = _scratch(spark, "parquet")
    (events(d) | tw.select_columns("event_id", "value") | tw.write_parquet(folder)).scan(context)
    return tw.read_parquet(folder).load(context).to_df()


def _csv_roundtrip(spark, d, context=WEEK):
    folder = _scratch(spark, "csv")
    (events(d) | tw.select_columns("event_id", "value") | tw.write_csv(folder)).scan(context)
    return tw.read_csv(folder, types={"time": "timestamp_ntz", "event_id": int, "value": float}).load(context).to_df()


def _stream_slices(spark, d, context=WEEK):
    frames = tw.stream(context, events(d) | tw.select_columns("event_id"), slices=4)
    out = None
    for frame in frames:
        df = frame.to_df()
        out = df if out is None else out.unionByName(df)
    return out


def windowed() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries over a part of their tables, whose edges shifts, tolerances and look-backs cross; for tests."""
    return {
        "filter_rows": _filter_rows, "add_columns": _add_columns, "select_columns": _select_columns, "drop_columns": _drop_columns, "clock_day": _clock_day, "clock_float": _clock_float, "empty_frame": _empty,
        "from_dataframe": _from_dataframe, "lag_1h": _lag_1h, "lead_1h": _lead_1h, "summarize_all": _summarize_all, "summarize_keyed": _summarize_keyed, "pipeline_chain": _pipeline_chain,
        "cycles": _cycles, "cycles_keyed": _cycles_keyed, "running_keyed": _running("user_id"), "running_keyless": _running(None), "rolling_1h_1d": _rolling, "rolling_hot_keys": partial(_rolling, by_buckets=8), "rolling_keyless": _rolling_keyless,
        "rolling_from": _rolling_from, "asof": _joined(), "asof_keyless": _joined(key=None), "asof_strict": _joined(strict=True), "asof_tolerance": _joined(tolerance=6 * HOUR), "asof_hot_keys": _joined(by_buckets=8),
        "asof_self_prev": _asof_self_prev, "future_join": _joined(forward=True), "future_keyless": _joined(forward=True, key=None), "future_strict": _joined(forward=True, strict=True), "future_tolerance": _joined(forward=True, tolerance=6 * HOUR),
        "interval_grid": _interval(), "interval_keyed": _interval(key="event_type"), "interval_closelast": _interval(closelast=True), "interval_keyed_closelast": _interval(key="event_type", closelast=True),
        **{f"summary_{k}": _summary(make, digits=digits) for k, (make, _, digits) in _SUMMARIES.items()},
        "rolling_wide": _rolling_wide, "rolling_months": _rolling_months, "rolling_custom": _rolling_custom, "running_custom": _running_custom, "interval_months": _interval_months, "interval_custom": _interval_custom, "lag_month": _lag_month,
        "summary_product": _product, "summary_first_last": _first_last, "custom_summarizer": _custom, "parquet_roundtrip": _parquet_roundtrip, "csv_roundtrip": _csv_roundtrip, "stream_slices": _stream_slices,
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query over the whole of its tables."""
    own = windowed() | {"summary_product": _product_whole}
    whole = {n: partial(own[n], context=_whole_context(n)) for n in _whole_sql() if n not in ("summary_product", "clock_day", "clock_float")}
    return own | whole


def _whole_context(name: str) -> tw.Context:
    if name == "interval_months":
        return SHIPPED_WHOLE
    if name.startswith("interval_"):
        return INTERVALS_WHOLE
    events_only = not name.startswith(("cycles", "summary_")) and name not in ("from_dataframe", "rolling_months") or name == "summary_first_last"
    return EVENTS_WHOLE if events_only else SHIPPED_WHOLE


def _whole_sql() -> dict[str, str]:
    """The SQL of each query over all rows of its tables."""
    rolled = lambda span: f"SELECT l.event_id AS id, count(r.ts) AS n, coalesce(sum(r.value), 0.0) AS s, max(r.value) AS m FROM events l LEFT JOIN events r ON r.user_id = l.user_id AND r.ts <= l.ts AND r.ts >= l.ts - {span} GROUP BY l.event_id"
    joined = lambda op, *a, **k: _joined_sql(op, *a, widen="true", window="true", **k)
    interval = lambda *a: _interval_sql(*a, start="2024-01-01", first="2024-01-02")
    end, shipped = "TIMESTAMP '2024-02-02' AS time", "TIMESTAMP '2002-01-01' AS time"
    out = {
        "filter_rows": "SELECT ts AS time, * EXCLUDE (ts) FROM events WHERE event_type = 'purchase' AND value > 20",
        "add_columns": "SELECT ts AS time, event_id, value * 2 AS double_value, event_type = 'click' AS is_click FROM events",
        "empty_frame": "SELECT ts AS time, event_id, CAST(0 AS BIGINT) AS d_count FROM events",
        "select_columns": "SELECT ts AS time, event_id, user_id, event_type FROM events",
        "drop_columns": "SELECT ts AS time, event_id, user_id, value FROM events",
        "from_dataframe": "SELECT o_orderkey, o_orderdate AS time FROM orders",
        "lag_1h": "SELECT ts + INTERVAL 1 HOUR AS time, event_id FROM events",
        "lead_1h": "SELECT ts - INTERVAL 1 HOUR AS time, event_id FROM events",
        "summarize_all": f"SELECT {end}, count(*) AS count, round(sum(value), 4) AS value_sum, round(sum(value) / count(*), 4) AS value_mean, min(value) AS value_min, max(value) AS value_max FROM events",
        "summarize_keyed": f"SELECT {end}, event_type, count(*) AS count, round(sum(value), 4) AS value_sum, round(sum(value) / count(*), 4) AS value_mean FROM events GROUP BY event_type",
        "pipeline_chain": f"SELECT {end}, event_type, user_id, count(*) AS count, round(sum(value * 0.5::DOUBLE), 4) AS fee_sum FROM events WHERE value > 10 GROUP BY event_type, user_id",
        "cycles": "SELECT l_shipdate AS time, count(*) AS count, round(sum(l_quantity), 4) AS l_quantity_sum, max(l_discount) AS l_discount_max FROM lineitem GROUP BY l_shipdate",
        "cycles_keyed": "SELECT l_shipdate AS time, l_returnflag, count(*) AS count, round(sum(l_extendedprice), 2) AS l_extendedprice_sum FROM lineitem GROUP BY l_shipdate, l_returnflag",
        "running_keyed": _running_sql("user_id", "true"), "running_keyless": _running_sql("", "true"),
        "rolling_1h_1d": f"WITH h AS ({rolled('INTERVAL 1 HOUR')}), d AS ({rolled('INTERVAL 1 DAY')}) SELECT e.ts AS time, e.event_id, e.user_id, h.n AS h_count, round(h.s, 4) AS h_value_sum, h.m AS h_value_max, d.n AS d_count, round(d.s, 4) AS d_value_sum, d.m AS d_value_max FROM events e JOIN h ON h.id = e.event_id JOIN d ON d.id = e.event_id",
        "rolling_keyless": "SELECT ts AS time, event_id, count(*) OVER o AS h_count, round(sum(value) OVER o, 4) AS h_value_sum, min(value) OVER o AS h_value_min, last_value(event_id) OVER o AS h_event_id_last FROM events WINDOW o AS (ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)",
        "rolling_from": "SELECT l.ts AS time, l.event_id, l.user_id, count(r.ts) AS d_count, round(coalesce(sum(r.value), 0.0), 4) AS d_value_sum FROM (SELECT * FROM events WHERE event_type = 'click') l LEFT JOIN events r ON r.event_type = 'purchase' AND r.user_id = l.user_id AND r.ts <= l.ts AND r.ts >= l.ts - INTERVAL 1 DAY GROUP BY l.ts, l.event_id, l.user_id",
        "asof": joined(">="), "asof_keyless": joined(">=", key=False), "asof_strict": joined(">"), "asof_hot_keys": joined(">="), "asof_tolerance": joined(">=", "l.ts - r.ts <= INTERVAL 6 HOUR"),
        "asof_self_prev": "SELECT ts AS time, event_id, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts) AS prev_event_id FROM events",
        "future_join": joined("<="), "future_keyless": joined("<=", key=False), "future_strict": joined("<"), "future_tolerance": joined("<=", "r.ts - l.ts <= INTERVAL 6 HOUR"),
        "interval_grid": interval(), "interval_keyed": interval("event_type"), "interval_closelast": interval("", True), "interval_keyed_closelast": interval("event_type", True),
        "summary_product": f"SELECT {shipped}, l_orderkey, CAST(product(l_linenumber) AS BIGINT) AS l_linenumber_product FROM lineitem GROUP BY l_orderkey",
        "summary_first_last": f"SELECT {end}, user_id, min_by(event_id, ts) AS event_id_first, max_by(event_id, ts) AS event_id_last FROM events GROUP BY user_id",
        "custom_summarizer": f"SELECT {end}, event_type, count(*) AS count, min(value) AS value_low, max(value) AS value_high FROM events GROUP BY event_type",
        "parquet_roundtrip": "SELECT ts AS time, event_id, value FROM events", "csv_roundtrip": "SELECT ts AS time, event_id, value FROM events", "stream_slices": "SELECT ts AS time, event_id FROM events",
    }
    out["rolling_hot_keys"] = out["rolling_1h_1d"]
    out |= _more_sql("true", "true", "true", "true", "2024-01-02", "1994-12-31", "2002-01-01")
    for name, (make, expression, digits) in _SUMMARIES.items():
        value = expression if digits is None else f"round({expression}, {digits})"
        out[f"summary_{name}"] = f"SELECT {shipped}, l_returnflag, {value} AS {make().outputs[0]} FROM lineitem GROUP BY l_returnflag"
    return out


def _more_sql(e: str, month: str, s: str, since: str, first: str, start: str, stop: str) -> dict[str, str]:
    """``e`` and ``s`` bound the rows of events and lineitem, ``since`` those of events a day before (and 15) and ``month`` lineitem's two months before."""
    frame = lambda key, span: f"(PARTITION BY {key} ORDER BY ts RANGE BETWEEN INTERVAL {span} PRECEDING AND CURRENT ROW)"
    ticks = f"RECURSIVE b AS (SELECT TIMESTAMP '{start}' AS b UNION ALL SELECT b + INTERVAL 1 MONTH FROM b WHERE b + INTERVAL 1 MONTH < TIMESTAMP '{stop}'), i AS (SELECT b, lead(b) OVER (ORDER BY b) AS e FROM b)"
    days = f"SELECT CAST(range AS TIMESTAMP) AS b FROM range(TIMESTAMP '{first}', TIMESTAMP '2024-02-03 00:00:01', INTERVAL 1 DAY)"
    return {
        "clock_day": f"SELECT c.range AS time, e.ts AS seen, e.event_id FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', INTERVAL 1 DAY) c ASOF LEFT JOIN (SELECT ts, event_id FROM events WHERE {_M}) e ON c.range >= e.ts",
        "clock_float": "SELECT CAST((k.range + 1) * 1000 AS DOUBLE) AS time, count(l_quantity) AS count, round(coalesce(sum(l_quantity), 0.0), 4) AS l_quantity_sum FROM range(199) k LEFT JOIN lineitem ON l_extendedprice >= k.range * 1000 AND l_extendedprice < (k.range + 1) * 1000 GROUP BY k.range",
        "rolling_wide": f"SELECT ts AS time, event_id, w_count, round(v, 4) AS w_value_sum, w_value_max, w_event_id_first FROM (SELECT ts, event_id, count(*) OVER o AS w_count, sum(value) OVER o AS v, max(value) OVER o AS w_value_max, first_value(event_id) OVER o AS w_event_id_first FROM events WHERE {since.format(15)} WINDOW o AS {frame('1', '15 DAY')}) WHERE {e}",
        "rolling_months": f"SELECT * FROM (SELECT l_shipdate AS time, l_orderkey, l_linenumber, l_returnflag, count(*) OVER o AS m_count, max(l_quantity) OVER o AS m_l_quantity_max FROM lineitem WHERE {month} WINDOW o AS (PARTITION BY l_returnflag ORDER BY l_shipdate RANGE BETWEEN INTERVAL 2 MONTH PRECEDING AND CURRENT ROW)) WHERE {s.replace('l_shipdate', 'time')}",
        "rolling_custom": f"SELECT ts AS time, event_id, user_id, d_count, d_value_low, d_value_high FROM (SELECT *, count(*) OVER o AS d_count, min(value) OVER o AS d_value_low, max(value) OVER o AS d_value_high FROM events WHERE {since.format(1)} WINDOW o AS {frame('user_id', '1 DAY')}) WHERE {e}",
        "running_custom": f"SELECT ts AS time, event_id, event_type, count(*) OVER o AS count, min(value) OVER o AS value_low, max(value) OVER o AS value_high FROM events WHERE {e} WINDOW o AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
        "interval_months": f"WITH {ticks} SELECT i.e AS time, count(l_shipdate) AS count, round(coalesce(sum(l_quantity), 0.0), 4) AS l_quantity_sum FROM i LEFT JOIN lineitem ON l_shipdate >= i.b AND i.e > l_shipdate WHERE i.e IS NOT NULL GROUP BY i.e",
        "interval_custom": f"SELECT d.b AS time, count(ts) AS count, min(value) AS value_low, max(value) AS value_high FROM ({days}) d LEFT JOIN events ON ts >= d.b - INTERVAL 1 DAY AND ts < d.b GROUP BY d.b",
        "lag_month": f"SELECT ts + INTERVAL 1 MONTH AS time, event_id FROM events WHERE {e}",
    }


def ticks_sql() -> dict[str, str]:
    days = "SELECT CAST(range AS TIMESTAMP) AS time FROM range(TIMESTAMP '{0}-01-01', TIMESTAMP '{1}-01-01', INTERVAL 1 DAY)"
    return {"clock_1900": days.format(1899, 1901), "clock_2040": days.format(2037, 2041), "clock_float": "SELECT CAST(range / 4.0 AS DOUBLE) AS time FROM range(400000)", "empty_frame": "SELECT ts AS time FROM events WHERE false"}


def oracle_sql() -> dict[str, str]:
    return windowed_sql() | _whole_sql()


def windowed_sql() -> dict[str, str]:
    rolled = lambda span: f"SELECT l.event_id AS id, count(r.ts) AS n, coalesce(sum(r.value), 0.0) AS s, max(r.value) AS m FROM (SELECT * FROM events WHERE {_W}) l LEFT JOIN events r ON r.user_id = l.user_id AND r.ts <= l.ts AND r.ts >= l.ts - {span} AND r.ts >= TIMESTAMP '2024-01-04' GROUP BY l.event_id"
    out = {
        "filter_rows": f"SELECT ts AS time, * EXCLUDE (ts) FROM events WHERE event_type = 'purchase' AND value > 20 AND {_W}",
        "add_columns": f"SELECT ts AS time, event_id, value * 2 AS double_value, event_type = 'click' AS is_click FROM events WHERE {_W}",
        "select_columns": f"SELECT ts AS time, event_id, user_id, event_type FROM events WHERE {_W}",
        "drop_columns": f"SELECT ts AS time, event_id, user_id, value FROM events WHERE {_W}",
        "empty_frame": f"SELECT ts AS time, event_id, CAST(0 AS BIGINT) AS d_count FROM events WHERE {_W}",
        "from_dataframe": "SELECT o_orderkey, o_orderdate AS time FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'",
        "lag_1h": "SELECT ts + INTERVAL 1 HOUR AS time, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-04 23:00:00' AND ts < TIMESTAMP '2024-01-11 23:00:00'",
        "lead_1h": "SELECT ts - INTERVAL 1 HOUR AS time, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 01:00:00' AND ts < TIMESTAMP '2024-01-12 01:00:00'",
        "summarize_all": f"SELECT TIMESTAMP '2024-01-12' AS time, count(*) AS count, round(sum(value), 4) AS value_sum, round(sum(value) / count(*), 4) AS value_mean, min(value) AS value_min, max(value) AS value_max FROM events WHERE {_W}",
        "summarize_keyed": f"SELECT TIMESTAMP '2024-01-12' AS time, event_type, count(*) AS count, round(sum(value), 4) AS value_sum, round(sum(value) / count(*), 4) AS value_mean FROM events WHERE {_W} GROUP BY event_type",
        "pipeline_chain": f"SELECT TIMESTAMP '2024-01-12' AS time, event_type, user_id, count(*) AS count, round(sum(value * 0.5::DOUBLE), 4) AS fee_sum FROM events WHERE {_W} AND value > 10 GROUP BY event_type, user_id",
        "cycles": f"SELECT l_shipdate AS time, count(*) AS count, round(sum(l_quantity), 4) AS l_quantity_sum, max(l_discount) AS l_discount_max FROM lineitem WHERE {_S} GROUP BY l_shipdate",
        "cycles_keyed": f"SELECT l_shipdate AS time, l_returnflag, count(*) AS count, round(sum(l_extendedprice), 2) AS l_extendedprice_sum FROM lineitem WHERE {_S} GROUP BY l_shipdate, l_returnflag",
        "running_keyed": _running_sql("user_id"),
        "running_keyless": _running_sql(""),
        "rolling_1h_1d": f"WITH h AS ({rolled('INTERVAL 1 HOUR')}), d AS ({rolled('INTERVAL 1 DAY')}) SELECT e.ts AS time, e.event_id, e.user_id, h.n AS h_count, round(h.s, 4) AS h_value_sum, h.m AS h_value_max, d.n AS d_count, round(d.s, 4) AS d_value_sum, d.m AS d_value_max FROM events e JOIN h ON h.id = e.event_id JOIN d ON d.id = e.event_id",
        "rolling_keyless": f"WITH w AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-04 23:00:00' AND ts < TIMESTAMP '2024-01-12') SELECT time, event_id, h_count, round(s, 4) AS h_value_sum, h_value_min, h_event_id_last FROM (SELECT ts AS time, event_id, ts, count(*) OVER o AS h_count, sum(value) OVER o AS s, min(value) OVER o AS h_value_min, last_value(event_id) OVER o AS h_event_id_last FROM w WINDOW o AS (ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)) WHERE {_W}",
        "rolling_from": f"SELECT l.ts AS time, l.event_id, l.user_id, count(r.ts) AS d_count, round(coalesce(sum(r.value), 0.0), 4) AS d_value_sum FROM (SELECT * FROM events WHERE event_type = 'click' AND {_W}) l LEFT JOIN events r ON r.event_type = 'purchase' AND r.user_id = l.user_id AND r.ts <= l.ts AND r.ts >= l.ts - INTERVAL 1 DAY GROUP BY l.ts, l.event_id, l.user_id",
        "asof": _joined_sql(">="), "asof_keyless": _joined_sql(">=", key=False), "asof_strict": _joined_sql(">"), "asof_hot_keys": _joined_sql(">="),
        "asof_tolerance": _joined_sql(">=", "l.ts - r.ts <= INTERVAL 6 HOUR", widen="ts >= TIMESTAMP '2024-01-04 18:00:00' AND ts < TIMESTAMP '2024-01-12'"),
        "asof_self_prev": f"SELECT ts AS time, event_id, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts) AS prev_event_id FROM events WHERE {_W}",
        "future_join": _joined_sql("<="), "future_keyless": _joined_sql("<=", key=False), "future_strict": _joined_sql("<"),
        "future_tolerance": _joined_sql("<=", "r.ts - l.ts <= INTERVAL 6 HOUR", widen="ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12 06:00:00'"),
        "interval_grid": _interval_sql(), "interval_keyed": _interval_sql("event_type"), "interval_closelast": _interval_sql(closelast=True), "interval_keyed_closelast": _interval_sql("event_type", True),
        "summary_product": f"SELECT TIMESTAMP '1999-01-01' AS time, l_orderkey, CAST(product(l_linenumber) AS BIGINT) AS l_linenumber_product FROM lineitem WHERE {_S} AND l_orderkey < 40 GROUP BY l_orderkey",
        "summary_first_last": f"SELECT TIMESTAMP '2024-01-12' AS time, user_id, min_by(event_id, ts) AS event_id_first, max_by(event_id, ts) AS event_id_last FROM events WHERE {_W} GROUP BY user_id",
        "custom_summarizer": f"SELECT TIMESTAMP '2024-01-12' AS time, event_type, count(*) AS count, min(value) AS value_low, max(value) AS value_high FROM events WHERE {_W} GROUP BY event_type",
        "parquet_roundtrip": f"SELECT ts AS time, event_id, value FROM events WHERE {_W}",
        "csv_roundtrip": f"SELECT ts AS time, event_id, value FROM events WHERE {_W}",
        "stream_slices": f"SELECT ts AS time, event_id FROM events WHERE {_W}",
    }
    out["rolling_hot_keys"] = out["rolling_1h_1d"]
    out |= _more_sql(_W, "l_shipdate >= TIMESTAMP '1991-11-01' AND l_shipdate < TIMESTAMP '1999-01-01'", _S, "ts >= TIMESTAMP '2024-01-05' - INTERVAL {} DAY AND ts < TIMESTAMP '2024-01-12'", "2024-01-06", "1992-01-01", "1999-01-01")
    for name, (make, expression, digits) in _SUMMARIES.items():
        column = make().outputs[0]
        value = expression if digits is None else f"round({expression}, {digits})"
        out[f"summary_{name}"] = f"SELECT TIMESTAMP '1999-01-01' AS time, l_returnflag, {value} AS {column} FROM lineitem WHERE {_S} GROUP BY l_returnflag"
    return out
