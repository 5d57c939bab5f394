"""Panel-state analytics and training-corpus operators as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so they need no copy of the package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
