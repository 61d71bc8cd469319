"""Operators for large training-data pipelines; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# functions for executors travel whole, so that executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
