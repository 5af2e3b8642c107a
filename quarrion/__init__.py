"""Spark-native analytics over marketplace-style inventory data."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel by value, so that no executor needs this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
