"""Spark-native toolkit for building and judging labelled text corpora."""

import sys

from pyspark import cloudpickle

# UDF bodies travel with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
