"""PySpark-native engine for graded pairwise interactions."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value: workers need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
