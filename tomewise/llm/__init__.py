"""Operations of a training-data pipeline. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are sent by value, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
