"""Readers, writers, table schemas and materialisation of intermediate results."""
