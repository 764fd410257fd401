"""Composition of steps over time."""
