"""Operators for preparing training corpora.

Nothing outside this subpackage imports it. Each module holds one operator with its general
interface; :mod:`corvid.llm.queries` applies them to the tables with production parameters.
"""
