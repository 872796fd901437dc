"""tidemark: an analytics engine expressed in Spark's own DataFrame and SQL API."""

__version__ = "0.1.0"
