"""Registered queries and the SQL each of them must equal."""

from catalog.base import ORACLES, QUERIES
from catalog import augment, metrics, pairs, runs, sampling, scoring, spans, tasks, training  # noqa: F401

__all__ = ["QUERIES", "ORACLES"]
