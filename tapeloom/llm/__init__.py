"""Operators for preparing training data; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
