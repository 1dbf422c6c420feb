"""Registered queries: bindings of operators to tables, with their SQL."""
