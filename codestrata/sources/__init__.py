"""Readers: graph tables, source trees, golden questions, event traces."""
