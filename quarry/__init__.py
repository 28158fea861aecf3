"""quarry: document intelligence, retrieval and corpus operators as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers get the package's functions by value and need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
