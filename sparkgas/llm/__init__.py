"""Operators for preparing training data, each a Spark job over whole tables.

Functions that run in Python workers are pickled by value, so executors need
PySpark and the public libraries only, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
