"""Spark-native macro, trade and official-statistics analytics."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

__version__ = "0.1.0"

# Python tasks carry the helper functions they call, so executors need not have this package installed.
register_pickle_by_value(sys.modules[__name__])
