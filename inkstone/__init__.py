"""inkstone: prepare, balance, rank and evaluate text-to-markup corpora on Spark.

Every public job is a ``DataFrame -> DataFrame`` function (chainable with
``df.transform``).  The only Python code that runs inside tasks is the XML
canonicaliser leaf in :mod:`inkstone.operators.markup`; everything else is
Catalyst expressions, joins, windows and aggregates.
"""

import sys as _sys

# Ship the library with the tasks: functions that run in Python workers (the
# canonicaliser leaf) are pickled by value, so executors need no installed copy.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without the hook
    pass

from inkstone.session import get_spark, checkpoint_dir  # noqa: E402

__all__ = ["get_spark", "checkpoint_dir"]
