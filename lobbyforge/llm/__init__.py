"""Operators of a training-data pipeline over a table of documents.

Nothing else in the library imports this subpackage.  ``registry`` lists the
queries and their SQL; ``__spark_entry__`` adds them when the subpackage exists.
"""
