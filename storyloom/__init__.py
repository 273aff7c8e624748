"""Spark-native analytics over news feeds: articles, duplicates, stories, topics, scores."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers travel with the job, so workers need no copy of the library.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
