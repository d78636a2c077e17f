"""Operators for building training data from documents, pages and vectors.

Nothing outside this package imports it. Functions of the package that run in
Python workers are sent with the job, so that executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
