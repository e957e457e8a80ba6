"""Operators of a training-data pipeline over a table of documents.

Nothing else in the library imports this subpackage; it can be removed as a
whole.  Each module holds one operator with a general interface, and
``queries`` holds the thin queries over the whole tables.
"""
