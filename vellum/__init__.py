"""Document analytics on Spark: corpora, releases, search, evaluation, logs and streams.

``sources`` and ``sinks`` read and write files, ``functions`` are column expressions, ``operators``
map DataFrames to DataFrames, ``streaming`` holds event-time and stateful operators and ``plans`` the
registered queries.
"""
