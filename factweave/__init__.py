"""factweave: fact, evidence and contract analytics on Spark DataFrames."""

__version__ = "0.2.0"
