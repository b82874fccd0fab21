"""Operators for preparing training text: filters, deduplication, mixing, packing, scoring.

Nothing else in the library imports this package. Each operator is a module with
a general interface; ``queries`` applies them to the given tables.
"""

from pyspark import cloudpickle

import newsloom

# Functions that run in Python workers travel with the task.
cloudpickle.register_pickle_by_value(newsloom)
