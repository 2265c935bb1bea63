"""Continuous versions of the batch operators."""
