"""tallyloom: reconciliation and data preparation as native Spark plans."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel whole, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
