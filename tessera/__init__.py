"""tessera: sentence-annotation corpora and text classification on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function built from
Spark SQL expressions, windows, joins and Spark ML, so it composes with
``df.transform`` and lets Catalyst plan the work.
"""

from tessera.session import build_session, checkpoint_dir, cut_lineage

__all__ = ["build_session", "checkpoint_dir", "cut_lineage"]
