"""Passive traffic-metadata analytics expressed as Spark DataFrame jobs."""
import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
