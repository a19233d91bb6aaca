"""Operators for preparing language-model training data, each a module of its own."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
