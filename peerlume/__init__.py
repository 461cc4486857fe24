"""Peerlume: a PySpark-native engine for measuring review concerns and curating review corpora."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions of this package travel to the executors by value, so they need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
