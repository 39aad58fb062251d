"""Reference results as DuckDB SQL, written separately from the Spark code."""
