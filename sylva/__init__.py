"""Structural entropy of graphs, and corpus preparation, as Spark DataFrame plans.

Functions that run on executors are pickled by value, so the executors need
no copy of this package.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
