"""Theme discovery and similarity search over embedded text corpora, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Ship the small task functions by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
