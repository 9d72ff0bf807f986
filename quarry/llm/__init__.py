"""Operators for building training data; nothing outside this package imports it."""
import sys

from pyspark.cloudpickle import register_pickle_by_value

# Executors need no copy of the package: functions travel with their code.
register_pickle_by_value(sys.modules[__name__])
