"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# The code of the Python stages travels with their plans, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
