"""Registered queries (one per operator of the inventory) and oracle SQL."""

from . import q_forecast, q_headway, q_incidents, q_quality, q_reports, q_ridership, q_series, q_sources  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
