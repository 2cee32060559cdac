"""A PySpark-native text retrieval and analytics engine."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code: the package needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
