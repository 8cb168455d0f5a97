"""Evidence retrieval and analytics expressed as Spark plans."""

import sys

from pyspark import cloudpickle

# functions go to the executors by value: they need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
