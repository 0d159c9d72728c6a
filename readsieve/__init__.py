"""Sequence sketching and containment search on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.0.1"

# The Arrow functions travel inside the task closures, so that executors need
# no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
