"""Pairforge: preference pairs, packing, BLEU and run analysis as Spark jobs."""

import sys

from pyspark import cloudpickle

# Python workers get the few functions they run with the task, so the package
# need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
