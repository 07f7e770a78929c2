"""Operators on live trace streams."""

import sys

from pyspark import cloudpickle

# State functions travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
