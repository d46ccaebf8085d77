"""Audio-provenance analytics and corpus preparation on Spark DataFrames."""

__version__ = "0.2.0"
