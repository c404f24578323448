"""Tabular preparation, training and evaluation as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# task code travels with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
