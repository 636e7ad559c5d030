"""Operators of a training-data pipeline, one module each.

Nothing else in netspark imports this subpackage.
"""
