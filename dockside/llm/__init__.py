"""Operators for preparing training data; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Tasks get these functions by value, so workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
