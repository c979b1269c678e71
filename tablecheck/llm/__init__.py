"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

import os
import sys

from pyspark import cloudpickle

# Where the workers cannot import this package, because it is neither on PYTHONPATH nor in the working folder, its
# functions travel with the jobs.
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
if _ROOT not in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
