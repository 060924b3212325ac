"""railyard: transit analytics as Spark DataFrame / SQL plans.

Packages: ``functions`` (column functions), ``sources`` (readers, sinks, test
views), ``operators`` (the analytics), ``plans`` (registered queries and
their DuckDB oracles), ``streaming`` (streaming ingestion).
"""

__version__ = "0.1.0"
