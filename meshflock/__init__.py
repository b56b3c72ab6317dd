"""Meshflock: Spark-native clustering of dynamic 2-D spatial data."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers inside their tasks, so that executors
# need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
