"""Spoken-media analytics as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
