"""Incremental runs: the interval plan over micro-batches of fragments."""
