"""Operators for preparing training text at corpus scale, and their queries.

Nothing outside this subpackage imports it.
"""
