"""All queries over the reference tables; importing the modules registers them."""

from . import bayes_queries, cluster_queries, linear_queries, model_queries, neural_queries, sequence_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
