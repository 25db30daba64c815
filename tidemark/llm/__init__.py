"""Operators for preparing training data for language models.

Each module holds one operator with its own interface; ``queries`` applies
them to the tables of a data folder.  Nothing else in the library imports this
subpackage.
"""
