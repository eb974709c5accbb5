"""Corpus symbol analytics and pseudonymization on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need not have this package installed: its UDFs travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
