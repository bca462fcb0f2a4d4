"""truthmill: text credibility analytics as Spark DataFrame jobs."""

__version__ = "0.1.0"
