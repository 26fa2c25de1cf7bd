"""helixframe: trajectory analytics expressed as PySpark DataFrame pipelines."""

__version__ = "0.1.0"
