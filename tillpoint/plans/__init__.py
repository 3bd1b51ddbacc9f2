"""Registered query catalogue (Spark side) and its DuckDB SQL oracle."""
