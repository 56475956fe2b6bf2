"""Operators on event sequences, large columns and texts; nothing outside this package imports it."""
