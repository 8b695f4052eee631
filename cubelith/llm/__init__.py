"""Operators for preparing training text and embeddings at scale.

Nothing else in the library imports this subpackage.  Its queries are in
:mod:`cubelith.llm.queries`; each operator has a module of its own with a
general interface.
"""
