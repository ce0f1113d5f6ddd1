"""tablesmith: profiling, data-quality, feature preparation and classification
over Spark DataFrames."""

__version__ = "0.1.0"
