"""Operators of a training-data pipeline; nothing else in the library depends on them."""

import sys

from pyspark import cloudpickle

# workers need no copy of this package: the functions in it travel with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])
