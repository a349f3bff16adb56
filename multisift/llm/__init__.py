"""Operators for preparing large text, page and embedding collections. Nothing outside this package imports it."""
