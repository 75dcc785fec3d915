"""Operators over training corpora: sharding, duplicates, quality, mixing, leaks, secrets, chat and language models."""
