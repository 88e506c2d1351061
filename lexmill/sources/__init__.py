from lexmill.sources.tables import live_rows, read_table

__all__ = ["live_rows", "read_table"]
