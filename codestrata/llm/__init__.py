"""Operators for training data: documents and source files in, selected or annotated rows out."""
