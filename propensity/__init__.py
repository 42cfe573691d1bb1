"""Propensity modelling on Spark: DataFrame in, DataFrame out.

Subpackages
-----------
sources     CSV and table scans, table sinks, saved pipelines
functions   column expressions (key hash, calendar parts, literal maps, linear scores)
operators   DataFrame operators and custom ML stages
plans       feature sets, training, tuning and evaluation built from the above
queries     every operator as a named query over the given tables
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run in Python workers travel by value: workers need numpy and pyarrow, not this library
cloudpickle.register_pickle_by_value(sys.modules[__name__])
