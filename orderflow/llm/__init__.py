"""Operators of a training-data pipeline, their queries and the SQL some of them are checked against.

Functions of this package that run in tasks travel with the job, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
