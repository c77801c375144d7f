"""Readers, page extraction and sinks."""
