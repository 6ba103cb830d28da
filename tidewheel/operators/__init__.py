from tidewheel.operators.intervalize import intervalize
from tidewheel.operators.joins import asof_join
from tidewheel.operators.rolling import add_rolling_columns
from tidewheel.operators.rowwise import add_columns, drop_columns, filter_rows, lag, select_columns
from tidewheel.operators.sinks import write_csv, write_parquet
from tidewheel.operators.summarize import add_summary_columns, summarize, summarize_cycles

__all__ = [
    "add_columns", "add_rolling_columns", "add_summary_columns", "asof_join", "drop_columns", "filter_rows",
    "intervalize", "lag", "select_columns", "summarize", "summarize_cycles", "write_csv", "write_parquet",
]
