"""Sorting and routing of alignment records on Spark, and operators for training data."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value, so that they needn't have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
