"""Scalar functions of rules, as columns."""
