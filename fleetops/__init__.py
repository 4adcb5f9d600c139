"""DataFrame operators for the records of batch-job fleets."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# The few functions that run on executors travel by value, so executors need not have this package.
register_pickle_by_value(sys.modules[__name__])
