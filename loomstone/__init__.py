"""Spark operators for profiling, normalising and packing text and conversation data."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a job needs no
# installed copy of the package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
