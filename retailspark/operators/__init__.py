"""Operators: each is a pure ``DataFrame -> DataFrame`` function."""
