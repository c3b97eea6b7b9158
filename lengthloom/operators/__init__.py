"""Relational operators: joins, aggregates, windows, rules."""
