"""Spark-native engine for large tag, vector and entity tables.

Operators take and return DataFrames or Columns; rules and vocabularies are
plain input tables; nothing in the library collects a table to the driver
unless its size was checked first.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
