"""Network-flow analytics as Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Task-side helpers travel inside the jobs, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
