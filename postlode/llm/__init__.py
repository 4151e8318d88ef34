"""Operators for preparing training data.  Nothing else in the library imports this package.

Its functions travel to the executors by value, so that a job needs the repository on the driver only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
