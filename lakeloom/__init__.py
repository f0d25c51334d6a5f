"""lakeloom: building, refreshing and auditing data assets with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers receive the helpers used inside pandas functions by value, so
# executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
