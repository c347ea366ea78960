"""Governance of text and tabular datasets as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers travel with their code, so that executors need no copy of
# this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
