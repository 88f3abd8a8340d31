"""Sales analytics and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors may lack this package on their path: functions sent to them carry their code along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
