"""Crawl-graph analytics as Spark DataFrame functions."""
