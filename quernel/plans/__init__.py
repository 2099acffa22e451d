"""Queries over the harness tables, each with DuckDB SQL for the same rows."""
