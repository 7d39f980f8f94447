"""tributary: a Spark-first federated analytics engine."""

__version__ = "0.1.0"
