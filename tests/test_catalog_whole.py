"""Queries over whole tables read every row."""

from compare import same
from conftest import DATA
from pyspark.sql import functions as F

from tidewheel import catalog


def test_product_answers_every_order(spark):
    orders = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey").distinct()
    got = catalog.queries()["summary_product"](spark, DATA)
    assert got.agg(F.count("l_linenumber_product")).first()[0] == orders.count() > 1000
    assert got.join(orders, "l_orderkey", "left_anti").count() == 0


def test_every_query_over_a_table_is_whole():
    names, whole = set(catalog.queries()), set(catalog._whole_sql())
    assert names == whole
    sql = catalog.oracle_sql()
    assert set(sql) == names and set(catalog.windowed()) <= names
    assert not any("ts >= TIMESTAMP '2024-01-05'" in q or "l_shipdate <" in q for q in sql.values())


def test_queries_cut_no_row(spark):
    rows = lambda table: spark.read.parquet(f"{DATA}/{table}.parquet").count()
    got, part = catalog.queries(), catalog.windowed()
    for name, table in (("select_columns", "events"), ("lag_1h", "events"), ("lead_1h", "events"), ("stream_slices", "events"), ("from_dataframe", "orders")):
        assert got[name](spark, DATA).count() == rows(table) > part[name](spark, DATA).count()
    counted = lambda query: query(spark, DATA).agg(F.sum("count")).first()[0]
    assert counted(got["cycles"]) == counted(got["summary_count"]) == rows("lineitem") > counted(part["cycles"])
    assert counted(got["interval_grid"]) == rows("events") > counted(part["interval_grid"])


def test_sources_without_rows(spark, duck):
    """Ticks of odd years and of floating-point time, and no rows: these read no table."""
    sql = catalog.ticks_sql()
    same(catalog.ticks(spark, DATA, catalog.YEAR_1900), duck.sql(sql["clock_1900"]))
    same(catalog.ticks(spark, DATA, catalog.YEAR_2040), duck.sql(sql["clock_2040"]))
    same(catalog.float_ticks(spark, DATA), duck.sql(sql["clock_float"]))
    same(catalog.nothing(spark, DATA), duck.sql(sql["empty_frame"]))
