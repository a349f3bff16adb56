"""Sinks for pictures of small result tables."""
