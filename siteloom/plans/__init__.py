"""Registered queries, shared storage of intermediate tables."""
