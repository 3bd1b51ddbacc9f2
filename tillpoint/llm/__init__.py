"""Operators of a training-data pipeline, written on Spark DataFrames.

Nothing else in the library imports this subpackage.  The modules hold one
operator each; ``queries`` registers them with production parameters.  The
Python helpers that run inside tasks are pickled by value, so executors need
no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
