"""Spark-first corpus analytics: sources, text functions, relational operators and query plans."""
