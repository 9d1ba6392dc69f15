"""Spark-native toolkit for building, judging and watching binary risk scores."""

import sys

from pyspark import cloudpickle

# Executors receive the few Python functions by value, so the package need not be
# installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
