"""Expressions over a panel of (date, code)."""
