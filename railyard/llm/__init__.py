"""Operators for large training-data pipelines, and their queries.

Nothing outside this subpackage imports it. ``railyard.llm.queries`` holds
the registry (``QUERIES`` and ``ORACLE``) that ``__spark_entry__.py`` adds when
the subpackage can be imported.
"""
