"""The query bindings: importing them fills the registry."""

from . import model_queries, panel_queries, star_queries, trip_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "model_queries", "panel_queries", "star_queries", "trip_queries"]
