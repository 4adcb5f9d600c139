"""Operators for large training corpora, over tables of documents."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of this package travel to the executors by value: these need numpy and pandas, not this package.
register_pickle_by_value(sys.modules[__name__])
