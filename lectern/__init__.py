"""lectern: a Spark engine for searching and maintaining document corpora."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors by value, so that no node needs it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
