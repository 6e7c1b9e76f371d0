"""Reading lists on Spark: import, search, statistics, similarity and export of saved articles."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so that the package does not
# have to be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
