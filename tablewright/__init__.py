"""Tabular profiling, preparation and model comparison on Spark."""

import sys

from pyspark import cloudpickle

# Functions handed to Python workers travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
