"""Operators that turn a column of pages into relations."""
