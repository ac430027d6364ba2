"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Each operator has a module
of its own with a general interface; ``queries`` holds the thin driver queries
``opN_<name>`` and ``oracles`` their SQL.
"""
