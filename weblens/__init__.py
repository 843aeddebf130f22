"""Access-log analytics on Spark."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python tasks travel with the job: the package need not be
# installed on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
