"""Relational analytics over source text and training corpora, on Spark."""
