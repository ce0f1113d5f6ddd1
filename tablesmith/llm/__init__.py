"""Operators for training-data pipelines. Nothing outside this package (but
for the registration in ``__spark_entry__.py``) imports it."""
