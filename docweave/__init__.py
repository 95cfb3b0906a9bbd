"""docweave: a Spark-native engine for document-recognition evidence."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run on executors travel by value, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
