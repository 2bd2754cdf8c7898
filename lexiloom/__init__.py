"""Vocabulary ingestion, matching and study analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python workers receive this package's functions by value, so it need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
