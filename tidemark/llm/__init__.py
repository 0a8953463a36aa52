"""Operators for preparing training corpora; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions go to the workers as code, so executors need no copy of the library on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
