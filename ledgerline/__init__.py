"""Retail analytics on Spark: master table, features, KPIs, retrieval, models.

Python functions that run inside executors (Arrow UDFs) are pickled by
value, so executors need no copy of this package on their path.
"""

import sys as _sys

try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pyspark
    pass
