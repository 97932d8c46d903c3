"""Measurement analytics as Spark DataFrame plans.

Every operator is a function from DataFrames to a DataFrame.  Column names are
parameters, so the same operator runs on assay tables and on any other table of
repeated measurements.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel by value: workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
