"""driftline: relations that change over time, on PySpark DataFrames."""

__version__ = "0.1.0"
