"""tabulith: document-table analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Kernels travel with the closure, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
