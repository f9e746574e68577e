"""Memoise Column builders.

Building one nested markup expression costs thousands of Py4J calls.  An
unresolved Column is reusable across plans of the same JVM, so builders called
with plain arguments (column names, numbers) are built once per process.
"""

from __future__ import annotations

import functools


def cached(fn):
    store: dict = {}

    @functools.wraps(fn)
    def wrapper(*args, **kwargs):
        from pyspark import SparkContext
        key = (id(SparkContext._gateway), args, tuple(sorted(kwargs.items())))
        try:
            hit = store.get(key)
        except TypeError:  # a Column argument: not hashable, build directly
            return fn(*args, **kwargs)
        if hit is None:
            hit = store[key] = fn(*args, **kwargs)
        return hit

    return wrapper
