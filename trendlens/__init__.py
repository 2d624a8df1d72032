"""Media-trend analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
