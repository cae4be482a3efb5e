"""Skein: Spark-first operators for curating large streams of documents.

Operators take and return DataFrames.  Functions that run in Python workers are
pickled by value, so executors need no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
