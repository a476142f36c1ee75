"""Operators of a training-data pipeline: one module per operator, `queries` registers them."""

import sys

from pyspark import cloudpickle

# Executors get the functions of these modules with the task, so they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
