"""Training-data operators on Spark: ten components and their queries.

Nothing else in the library imports this subpackage.
"""
