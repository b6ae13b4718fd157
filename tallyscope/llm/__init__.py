"""Operators over text corpora: scoring, tokenising, deduplication, scans and packing."""

import sys

from pyspark import cloudpickle

# functions of this subpackage travel to the executors by value: these need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
