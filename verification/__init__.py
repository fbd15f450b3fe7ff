"""Test tables derived from the given parquet files, and SQL to check results against."""
