"""Statistical learning, probabilistic queries and sequential decisions as Spark dataflow."""

__version__ = "0.1.0"
