"""Operators for training-data pipelines. Nothing else in the library imports
this package; ``__spark_entry__`` registers its queries when it is present."""
