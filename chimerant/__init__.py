"""Chimerant: a PySpark-native engine for interpreting fusion events, with reusable query operators."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
