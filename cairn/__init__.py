"""Feature, modelling and raster-table operators for Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this package with each task, so they need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
