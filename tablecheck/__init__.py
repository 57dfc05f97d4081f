"""Data-parity analytics on Spark."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: what Python functions use of it travels with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
