from tidewheel.sources.files import read_csv, read_parquet
from tidewheel.sources.memory import clock, empty_frame, from_dataframe

__all__ = ["clock", "empty_frame", "from_dataframe", "read_csv", "read_parquet"]
