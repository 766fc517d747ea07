"""tarnwell: Spark-first operators over the data a replicated log-structured store makes."""

__version__ = "0.1.0"
