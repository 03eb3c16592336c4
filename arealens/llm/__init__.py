"""Operators for preparing training text: dedup, joins, scans, packing, mixing.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to DataFrames; the registered queries live in ``queries.py``.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the task, so executors need
# no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
