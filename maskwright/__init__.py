"""Personal-data scrubbing, restoring and scoring as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code, so the package does not
# have to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
