"""Document assistance over large text collections, as Spark jobs.

The way through the package: ``sources`` reads tables and holds the index,
``operators`` are functions from DataFrame to DataFrame, ``functions`` are the
column expressions they share, ``plans`` string operators together, and
``streaming`` keeps an index up to date from a folder of new files.
"""
