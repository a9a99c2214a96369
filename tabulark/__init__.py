"""tabulark: tabular analysis operators as Spark DataFrame plans.

Every operator takes DataFrames and returns DataFrames; Catalyst plans them."""

import sys as _sys

__version__ = "0.1.0"

# The few functions that run inside Python workers (mapInPandas/applyInPandas
# bodies) are shipped by value, so executors do not need this package installed.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without the hook
    pass
