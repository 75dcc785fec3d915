"""Relational operators over posting, snapshot, run and product-event tables."""
