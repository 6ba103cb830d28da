"""Causal time-series analytics on Spark.

A pipeline is a lazy function of a time window; evaluating it binds the window, which reaches the
scans as pushed filters, and leaves the rest to Spark.
"""

from tidewheel import acausal
from tidewheel.context import Context, Months, months, years
from tidewheel.frame import LoadedFrame, TimeFrame
from tidewheel.functions import (
    Correlation, Count, Covariance, DotProduct, First, FoldSummarizer, Last, Max, Mean, Min, Moment, Product, Std, Sum, Summarizer, SumPower, Variance,
)
from tidewheel.operators import (
    add_columns, add_rolling_columns, add_summary_columns, asof_join, drop_columns, filter_rows, intervalize, lag, select_columns, summarize, summarize_cycles, write_csv, write_parquet,
)
from tidewheel.pipeline import Pipeline, load, scan, stream
from tidewheel.sources import clock, empty_frame, from_dataframe, read_csv, read_parquet

__all__ = [
    "LoadedFrame", "Context", "Correlation", "Count", "Covariance", "DotProduct", "First", "FoldSummarizer", "Last", "Max", "Mean", "Min", "Moment", "Months", "Pipeline", "Product", "Std", "Sum",
    "SumPower", "Summarizer", "TimeFrame", "Variance", "acausal", "add_columns", "add_rolling_columns", "add_summary_columns", "asof_join", "clock", "drop_columns", "empty_frame",
    "filter_rows", "from_dataframe", "intervalize", "lag", "load", "months", "read_csv", "read_parquet", "scan", "select_columns", "stream", "summarize", "summarize_cycles", "write_csv", "write_parquet", "years",
]
