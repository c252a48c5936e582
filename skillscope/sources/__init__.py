"""Sources and sinks: declared schemas, CSV/parquet readers, parquet sink,
and the bindings that shape the driver tables into the engine's tables."""

from .readers import DriverTables, read_csv_table, read_messages_csv, write_parquet  # noqa: F401
