"""Every registered query, on views derived from the test tables, with the same in DuckDB SQL."""
