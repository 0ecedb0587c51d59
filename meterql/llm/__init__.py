"""Operators for preparing training text at scale.

Nothing else in the package imports this subpackage; the query registry adds
its queries only where it is installed.
"""
