"""Queries by name. The catalogue comes first, as every module of queries registers with it."""

from tarnwell.plans import catalogue  # noqa: F401
