"""Named queries over the test tables (used by __spark_entry__ and bench)."""
