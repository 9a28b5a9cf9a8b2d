"""spanlake: find and rank time spans in multi-channel media tables with Spark."""
import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions shipped to executors travel inside the task, so a cluster needs no
# separate install of this package on its workers.
register_pickle_by_value(sys.modules[__name__])
