"""Operators for preparing training text, and the queries that apply them to the given tables.

Task functions of this package travel to the executors by value, so that workers need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
