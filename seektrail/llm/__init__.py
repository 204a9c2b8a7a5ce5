"""Operators for preparing training data: filters, near-duplicates, packing, mixing, search."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
