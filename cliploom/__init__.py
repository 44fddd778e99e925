"""Screening and assembly of time-ranged media segments, and corpus preparation, on PySpark."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions by value, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
