"""Operators of a training-data pipeline over document and vector tables.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
queries; every operator has a module of its own with a general interface.
"""
