"""Operators for large training-text tables, and the queries that apply them."""

import sys

from pyspark import cloudpickle

# the functions that run inside tasks travel with the job; executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
