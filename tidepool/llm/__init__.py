"""Operators for preparing language-model training data.

Functions of this subpackage travel to executors by value, so a worker needs no copy of the
repository on its own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
