"""Bars and stops over event streams."""
