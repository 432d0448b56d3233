"""Writing tables: Parquet in full precision, CSV as a rounded view."""
