"""Weekly digest analytics for captured publisher pages and feeds, on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code along, so executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
