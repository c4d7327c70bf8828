"""Queries by name, with DuckDB SQL for the same rows."""
