"""Relational operators that are more than one DataFrame call."""
