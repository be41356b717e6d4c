"""Question-bank and practice-log analytics as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# ship the few Python helpers to workers by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
