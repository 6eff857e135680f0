"""The SQL each query must equal."""
