"""distillery: distillation-data operators as lazy Spark DataFrame functions.

Every public operator takes and returns a ``DataFrame`` and adds no action
of its own, except where a documented small scalar is needed (a row count,
per-partition counts for the row index, a split histogram).
"""

from __future__ import annotations

import sys

try:  # ship this package's functions by value to Python workers, so
    # mapInPandas / pandas_udf callables resolve on executors that do not
    # have the package on their path.
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

__all__ = ["session"]
