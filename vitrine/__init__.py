"""vitrine: catalog analytics as Spark DataFrame operators.

Layout: ``sources`` (JSON / Parquet / derived catalog), ``functions``
(column expressions), ``operators`` (DataFrame → DataFrame stages),
``plans`` (named reports), ``streaming`` (incremental ingest).
"""

__version__ = "0.1.0"
