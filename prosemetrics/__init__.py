"""prosemetrics: text-quality analytics expressed as PySpark DataFrames."""

__version__ = "0.1.0"
