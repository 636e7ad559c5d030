"""netspark: graph analytics over edge tables, written as Spark DataFrame plans."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so that executors need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
