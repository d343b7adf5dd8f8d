"""Batch data-quality and anomaly audit as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python functions that run inside tasks travel with the plan, so
# executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
