"""halosift: selection, feature preparation, training and evaluation of
subcluster classifiers, expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The functions that run in Python workers travel with their job, so executors
# need no copy of this package and no search path that leads to it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
