"""Operators for building language-model training data, one module each; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the tasks that call them, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
