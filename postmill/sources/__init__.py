"""Readers, writers and the binding of the benchmark tables to posting shapes."""
