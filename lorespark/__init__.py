"""Spark-first analytics over repositories, pages, ingested items and their graph."""
