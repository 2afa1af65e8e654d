"""Spark-native analytics for structure-aware, graph-enhanced retrieval."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code: workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
