"""notemill: analysis of document collections on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions travel to the Python workers by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
