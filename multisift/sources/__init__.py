"""Readers, writers and generators of count matrices and fragment tables."""
