"""Operators for preparing language-model training data.

Ten operators, each with its own general interface, plus the thin ``opN_*``
queries over them in :mod:`shredline.llm.queries`. Nothing else in the library
imports this subpackage.
"""
