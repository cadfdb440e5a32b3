"""shelflink: links web pages to catalogue entries with Spark."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: its few Arrow functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
