"""Security-log and operations analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in executors travel with the job, so that the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
