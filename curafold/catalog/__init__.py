"""Registered queries over the test tables, each with its SQL counterpart where one exists."""

from curafold.catalog import curation, evaluation, explanation, features, modelling, splitting  # noqa: F401
from curafold.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
