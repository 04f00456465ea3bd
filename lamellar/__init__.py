"""lamellar: a Spark-native engine for dataset preparation, binary payload processing and representation benchmarks.

Functions that run on executors are pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
