"""Operators for preparing training text at scale, one module each; `queries` registers them."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers by value, so that it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
