"""Catalog and engagement analytics on Spark."""

import sys

from pyspark import cloudpickle

#: Functions that run on executors are sent with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
