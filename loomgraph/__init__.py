"""A property-graph engine on Spark."""

import sys

from pyspark import cloudpickle

# Executors get this code with the functions that use it; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
