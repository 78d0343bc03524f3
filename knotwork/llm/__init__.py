"""Operators for preparing language-model training text.

Each module holds one operator; ``queries`` registers them under the names
``op1_`` to ``op10_``. Nothing outside this package imports it.
"""
