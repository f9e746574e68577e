"""Operators of a training-data pipeline over ``documents``, ``pages`` and ``conversations``.

Each numbered operator has a module of its own; :mod:`inkstone.llm.queries` registers
one thin query per operator.  Nothing outside this package imports it.
"""
