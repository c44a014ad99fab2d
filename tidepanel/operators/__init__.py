"""Joins, transforms, selection, labels, evaluation and backtests on panels."""
