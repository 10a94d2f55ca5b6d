"""Operators of a training-data pipeline over large text corpora.

Functions of this subpackage travel to Python workers by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
