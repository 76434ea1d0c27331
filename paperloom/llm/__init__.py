"""Operators of a training-data pipeline: one module each, with their queries in ``queries``.

Nothing outside this subpackage imports it.
"""
