"""Tidemark: batch and streaming PySpark jobs for market news, equity research and text corpora."""

import sys

from pyspark import cloudpickle

# Functions go to the workers as code, so executors need no copy of the library on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
