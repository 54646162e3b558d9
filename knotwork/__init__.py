"""knotwork: set-oriented analytics over code graphs and the knowledge attached to them, on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers go by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
