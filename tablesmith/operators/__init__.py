"""Spark operators: profiling, quality, fixes, preparation, models, evaluation."""
