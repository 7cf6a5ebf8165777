"""Spark jobs for reviewing multi-document case files in bulk."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
